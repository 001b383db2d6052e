"""The ten operators against brute force, on small frames that hold nulls, empty and repeated rows, copies and long texts."""

import hashlib
import os
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import components, licences, line_dedup, media, mixing, ngram_join, packing, pii, quality, suffix_dedup, vectors
from ledgerloom.llm.queries import tokenizer_path

BLANK = " \t\n\x0b\x0c\r"


def _corpus(seed=3, n=60):
    """Texts with exact and near copies, shared lines and passages; then null, empty, blank and long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8)))
    pool = [word() for _ in range(400)]
    line = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    common = [line(9) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind == 2 and rows:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = "\n".join([line(30), rng.choice(common).upper() if kind == 3 else "  " + rng.choice(common) + "\t", line(25)])
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "ab"), (n + 4, line(6000)), (n + 5, "\n".join([common[0]] * 3))]
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """Extra columns have clashing names; the last rows have no id."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", 1) for i, t in corpus] + [(None, "a row without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `size` string, n_lines int").repartition(3)


def _words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_line_dedup(docs, corpus):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANK))
    holders = defaultdict(set)
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    heavy = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    assert heavy
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs.drop("size")).collect()}
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if heavy.get(key(x), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def _components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs, corpus, n, num):
    sets = {}
    for i, t in corpus:
        w = _words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = _components(links, sets)
    got = {r["doc_id"]: r for r in ngram_join.join_components(docs, n, num, 100).collect() if r["doc_id"] is not None}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    kept = {r["doc_id"] for r in ngram_join.one_of_each(docs, n, num, 100).collect()}
    assert kept == {i for i in sets if want[i] == i} | {None}


def test_ngram_join_through_rows_without_id(spark):
    """Rows without an id link others by their text; components of such rows alone have no id."""
    base = [f"w{k}" for k in range(120)]
    step = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(base))
    rows = [(5, step(3)), (None, step(3, 60)), (4, step(60)), (None, "some other words here"), (None, "some other words here"), (9, step(3, 30, 60, 90, 110))]
    texts = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    alike = lambda a, b: 100 * len(texts[a] & texts[b]) >= 93 * len(texts[a] | texts[b])
    assert alike(0, 1) and alike(1, 2) and not alike(0, 2)
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 93, 100).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, [(5, 4), (None, 4), (4, 4), (None, None), (None, None), (9, 9)]))


def test_suffix_filter():
    """The filter never rejects a pair that links, at the first shingle that both share, and rejects most that don't."""
    rng = np.random.default_rng(4)
    filters, rejected, others = ngram_join._Filters(90, 100), 0, 0
    for _ in range(400):
        common = rng.choice(1 << 30, rng.integers(20, 90), replace=False)
        a, b = (np.unique(np.concatenate((common, rng.choice(1 << 30, rng.integers(0, 14))))) for _ in range(2))
        first = min(set(a.tolist()) & set(b.tolist()))
        pos = [int(np.searchsorted(x, first)) for x in (a, b)]
        cells = [np.minimum(np.bincount(x[p + 1 :] % ngram_join.CELLS, minlength=ngram_join.CELLS), 255).astype(np.uint8)[None] for x, p in zip((a, b), pos)]
        both, zero = len(np.intersect1d(a, b)), np.zeros(1, np.int64)
        links = 100 * both >= 90 * (len(a) + len(b) - both)
        passes = filters.alike(cells[0], zero, np.array([len(a)]), np.array([pos[0]]), cells[1], zero, np.array([len(b)]), np.array([pos[1]]))[0]
        assert passes or not links
        others += not links
        rejected += not passes
    assert rejected > 0.5 * others > 20


def test_large_prefix_groups(spark):
    """More texts than a small group share a shingle: stars and blocks lose no link."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(58)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(links, sets)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    want = _components(links, {x for p in links for x in p})
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


@pytest.mark.parametrize(("split", "often"), [(suffix_dedup.SPLIT, suffix_dedup.OFTEN), (2, 32), (3, 2), (1000, 2)])
def test_suffix_dedup(docs, corpus, split, often, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    seen: dict[bytes, int] = {}
    raw = {i: (t or "").encode() for i, t in corpus}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            seen.setdefault(raw[i][k : k + 50], i)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        kept = bytes(c for k, c in enumerate(b) if not gone[k + 1])
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["spans"]), bytes(got[i]["kept"])) == (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), kept)


def test_suffix_dedup_shuffles_little(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    executors = spark.sparkContext._jsc.sc().statusStore().executorList
    shuffled = lambda: sum(x.totalShuffleWrite() for x in (lambda e: [e.apply(i) for i in range(e.size())])(executors(True)))
    before = shuffled()
    suffix_dedup.remove_repeats(df).write.format("noop").mode("overwrite").save()
    time.sleep(1)  # the last tasks are told of a little later
    ratio = (shuffled() - before) / df.selectExpr("sum(octet_length(text))").first()[0]
    assert ratio < 4.4


def test_suffix_dedup_some_grams_at_a_time(spark, docs, monkeypatch):
    tables, write = [], suffix_dedup.Scratch.write
    monkeypatch.setattr(suffix_dedup.Scratch, "write", lambda self, df, name, *a: tables.append(name) or write(self, df, name, *a))
    found = []
    for size in (26, 1000):
        tables.clear()
        monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", size)
        found.append((sorted(map(repr, suffix_dedup.remove_repeats(docs).collect())), tables.count("segments")))
    assert found[0][0] == found[1][0] and found[1][1] > max(3, found[0][1])


def test_suffix_dedup_of_hot_phrases(spark):
    """A phrase of 40 bytes in many contexts is parted; rows that repeat an id are cut by what their own texts repeat."""
    rng = random.Random(9)
    letters = lambda k: "".join(rng.choice("abcdef") for _ in range(k))
    phrase, passage = letters(40), letters(120)
    rows = [(i, letters(12) + phrase + letters(12) + (passage if i % 10 == 9 else "")) for i in range(120)]
    rows += [(i + 200, rows[i][1][i % 5 :]) for i in range(0, 120, 3)]
    seen: dict[str, int] = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
    rows += [(400, passage + letters(60)), (400, letters(60) + passage), (400, letters(180))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen.get(t[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want.append((i, "".join(c for c, g in zip(t, gone) if not g)))
    assert sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in got) == sorted(want)


def test_suffix_arrays_decide(monkeypatch):
    """What first documents keep comes from neighbours in the suffix array: in any other order equal windows aren't found."""
    import pyarrow as pa

    rng = random.Random(2)
    common = "".join(rng.choice("abcd") for _ in range(60))
    texts = [("%02d" % i + common + "%02d" % i)[i % 3 :].encode() for i in range(12)]
    t = pa.table({"h": [1] * 12, "g": list(range(12)), "doc_id": list(range(12)), "segment": pa.array(texts, pa.binary()), "told": [True] * 12})
    first: dict[bytes, int] = {}
    for i, x in enumerate(texts):
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], i)
    want = {i: sum(1 << k for k in range(len(x) - 49) if first[x[k : k + 50]] == i) for i, x in enumerate(texts)}
    kept = lambda: dict(zip(*(suffix_dedup._kept_of_segments(t, np.zeros(1, np.int64)).to_pydict()[c] for c in ("doc_id", "kept"))))
    assert kept() == {i: b for i, b in want.items() if b}
    right = suffix_dedup.suffix_arrays
    monkeypatch.setattr(suffix_dedup, "suffix_arrays", lambda symbols, size: np.sort(right(symbols, size), axis=1))
    assert kept() != {i: b for i, b in want.items() if b}


def test_suffix_arrays():
    """Texts end with their smallest symbol, which may stand elsewhere too, as it does between segments."""
    rng = np.random.default_rng(0)
    size = np.array([1, 2, 7, 40, 40])
    symbols = np.zeros((5, 40), np.int16)
    for i, n in enumerate(size):
        symbols[i, : n - 1] = rng.integers(0, 4, n - 1)
    got = suffix_dedup.suffix_arrays(symbols, size)
    for i, n in enumerate(size.tolist()):
        text = symbols[i, :n].tolist()
        assert got[i, :n].tolist() == sorted(range(n), key=lambda k: text[k:])  # noqa: B023


def test_mixing(docs, corpus):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    per = defaultdict(list)
    for r in rows:
        per[r["source"]].append(r)
        assert r["size"] == len(_words(r["text"])) and 0 <= r["taken"] <= 3 * r["size"]
    sizes = [sum(r["size"] for r in v) for _, v in sorted(per.items(), key=lambda x: (x[0] is None, x[0]))]
    for v in per.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1 and v[0]["source_size"] == sum(r["size"] for r in v)
    assert abs(sum(v[0]["target"] for v in per.values()) - sum(sizes)) < 1e-6
    quotas = mixing.split_quotas([7, 0, 30], 5, 1)
    assert quotas.sum(1).tolist() == [7, 0, 30] and quotas.min() >= 0
    texts = mixing.mixed_texts(docs).collect()
    assert abs(sum(len(_words(r["text"])) for r in texts) - sum(r["taken"] for r in rows)) == 0


def test_mixing_deals_to_shards(spark, docs):
    """Pieces and the stage's own output hold the tree's block quotas exactly, source by source and shard by shard."""
    options = {"shards": 5, "block_words": 40, "seed": 3}
    per, blocks, at = defaultdict(int), defaultdict(set), defaultdict(list)
    taken, rows = Counter(), mixing.mix(docs, **options).collect()
    for r in rows:
        taken[r["source"]] += r["taken"]
        for p in r["pieces"]:
            blocks[r["source"], p["shard"]].add(p["block"])
            per[r["source"], p["shard"]] += p["n_words"]
            at[r["source"], p["block"]].append((p["at"], p["n_words"]))
    sources = sorted(taken, key=lambda s: (s is None, s))
    words = Counter()
    for r in rows:
        words[r["source"]] += r["size"]
    drawn = [len({p["block"] for r in rows if r["source"] == s for p in r["pieces"]}) for s in sources]
    for s, n in zip(sources, drawn):  # whole readings, then as many blocks as the rest takes, one more at most for a short one
        whole, rest = divmod(taken[s], words[s])
        assert n - whole * -(-words[s] // 40) in (-(-rest // 40), -(-rest // 40) + 1)
    quotas = mixing.split_quotas(drawn, 5, 3)
    assert [[len(blocks[s, k]) for k in range(5)] for s in sources] == quotas.tolist() and quotas.min() > 0
    assert all(sum(n for _, n in v) <= 40 and [a for a, _ in sorted(v)] == np.cumsum([0] + [n for _, n in sorted(v)])[:-1].tolist() for v in at.values())
    got, order = defaultdict(int), defaultdict(list)
    for shard, part in enumerate(mixing.mixed_texts(docs, **options).rdd.glom().collect()):
        for r in part:
            got[r["source"], shard] += len(_words(r["text"]))
            order[shard].append(r["source"])
    assert got == per
    assert all(sum(a != b for a, b in zip(v, v[1:])) > 10 for v in order.values())  # shuffled, not grouped by source
    other = mixing.mix(docs, **options | {"seed": 4}).where("doc_id = 7").collect()[0]["pieces"]
    assert other != next(r["pieces"] for r in rows if r["doc_id"] == 7)
    for n in (1, 2, 3, 12, 97):
        assert sorted(mixing.block_place(b, n, 17, 1) for b in range(n)) == list(range(n))
    first = spark.range(97).selectExpr("id as b", "0L as t", "123L as block_key", "97L as blocks", f"{mixing.radix(97)[0]}L as wide", f"{mixing.radix(97)[1]}L as high").selectExpr("b", f"{mixing._PLACE} as o").collect()
    assert [r["o"] for r in first] == [mixing.block_place(r["b"], 97, 123, 0) for r in first]
    parts = mixing.shard_rows(mixing.mix(docs, **options), 5, 3, parts=3).rdd.glom().collect()
    assert len(parts) == 15 and all(r["piece"]["shard"] == k // 3 for k, part in enumerate(parts) for r in part)


def test_mixing_draws_permuted_blocks(spark):
    """Which documents a small quota takes is up to the permutation of blocks: they come from all over the line, and change with the seed."""
    docs = spark.createDataFrame([(i, "a" if i < 400 else "b", " ".join(["w"] * (5 + i % 7))) for i in range(800)], "doc_id long, source string, text string")
    sizes = [sum(5 + i % 7 for i in range(400)), sum(5 + i % 7 for i in range(400, 800))]
    got = {}
    for seed in (1, 2):
        rows = mixing.mix(docs, weights=(1.0, 5.0), shards=4, block_words=64, seed=seed, keep=["doc_id", "source"]).collect()
        assert "text" not in rows[0].asDict()
        for source, target in zip("ab", mixing.source_targets(sizes, [1.0, 5.0])):
            assert sum(r["taken"] for r in rows if r["source"] == source) == round(target)
        pieces = [p for r in rows if r["source"] == "a" for p in r["pieces"]]
        got[seed] = {p["block"] for p in pieces}
        per = Counter()
        for p in pieces:
            per[p["block"]] += p["n_words"]
        assert 1 < len(per) < sizes[0] // 64 and max(per) - min(per) > 1.5 * len(per) and sum(n < 64 for n in per.values()) <= 2
    assert got[1] != got[2]
    for z, q, b in ((1000, 999, 64), (1000, 0, 64), (1000, 1000, 64), (1000, 2500, 64), (63, 100, 64), (130, 129, 64), (0, 0, 64)):
        blocks, whole, drawn, rest = mixing.draws(z, q, b)
        for short_at in range(blocks if drawn else 0):
            k, last = mixing.last_words(rest, drawn, blocks, z, b, short_at)
            lengths = [b] * blocks
            lengths[short_at] = z - (blocks - 1) * b
            assert k <= blocks and sum(lengths[: k - 1]) + last == rest and 0 < last <= lengths[k - 1] and whole * z + rest == q


def test_mixing_keeps_bytes(spark):
    """Pieces of a text are its own bytes, line ends and blanks with them: all of them, or up to where the quota ends."""
    text = " \n" + "".join(f"w{i}é\t \n" if i % 3 else f"w{i} " for i in range(1000))
    df = spark.createDataFrame([(0, "a", text), (1, "b", text.upper())], "doc_id long, source string, text string")
    whole = {r["source"]: r["text"] for r in mixing.mixed_texts(df, weights=(1.0, 3.0)).collect() if r["source"] == "a"}
    assert len(whole["a"].split()) == 500 and text.startswith(whole["a"])
    for source, of in (("a", text), ("b", text.upper())):
        pieces = [r["text"] for r in mixing.mixed_texts(df, weights=(1.0, 1.0), shards=3, block_words=70).where(f"source = '{source}'").collect()]
        assert len(pieces) == 15 and "".join(sorted(pieces, key=of.index)) == of


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    per, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(per[i], key=lambda r: r["start"])
        assert b"".join(bytes(p["ids"]) for p in pieces) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(p["doc_tokens"] == len(ids) and p["length"] * 4 == len(p["ids"]) for p in pieces)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 or at == 2048


def test_tokenizer():
    """Merging by rank gives the library's ids, also where blanks, line ends, added tokens and punctuation meet; other kinds of file go through the library."""
    library = packing.Tokenizer(tokenizer_path())
    assert library.ranked is not None
    rng = random.Random(8)
    units = ["word", "don't", "it's.", "é!", "x<|endoftext|>", "<|endoftext|>", "a.\nb,", "\n", "", "3.14", "12)", "»«.", "o'", "日本。.", "ß''s", "'s", "--", "\t", "Ⅷ.", "q_"]
    texts = [" ".join(rng.choice(units[:20 if i % 2 else 6]) for _ in range(rng.randint(0, 12))) for i in range(1500)]
    letters = [chr(c) for c in [*range(0x250), *range(0x300, 0x330), *range(0x600, 0x680), *range(0x2000, 0x2040), *range(0x1F600, 0x1F610), 0x85, 0x3000, 0xFEFF, 0x10FFFF]]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(500)] + ["x" * 30000, " " * 30000, "\n " * 9000]
    for t in texts:
        assert library.encode(t).tolist() == library.library.encode(t, add_special_tokens=False).ids, t
    other = packing.Tokenizer(os.path.join(os.path.dirname(tokenizer_path()), "word_bpe_49k.json"))
    assert other.ranked is None and other.encode("Some words.").tolist() == other.library.encode("Some words.", add_special_tokens=False).ids


def test_media(docs, corpus):
    files = media.write_media(docs)
    got = {r["doc_id"]: r for r in media.read_media(files).collect()}
    for i, t in corpus:
        b = (t or "").encode()
        want = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert bytes(got[i]["payload"]) == want and got[i]["n_bytes"] == len(b)
        clips = got[i]["clips"]
        assert clips[0]["first_frame"] == 0 and sum(c["n_frames"] for c in clips) == len(want) // 576
        assert zlib.crc32(want[-32:]) == zlib.crc32(bytes(got[i]["payload"])[-32:])


def test_media_of_others(spark):
    """Files without an index, with places counted from the file's start, with other chunks between, and cut short."""
    texts = ["x" * 3000, "".join(chr(33 + k % 90) for k in range(5000))]
    files = [bytes(r["media"]) for r in media.write_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for f in files:
        seconds, frames = media.read_avi(f)
        at, movie = f.index(b"idx1"), f.index(b"movi")
        assert media.read_avi(f[:at]) == (seconds, frames) and len(frames) > 1
        index = f[at + 8 :]
        moved = b"".join(index[i : i + 8] + (int.from_bytes(index[i + 8 : i + 12], "little") + movie).to_bytes(4, "little") + index[i + 12 : i + 16] for i in range(0, len(index), 16))
        assert media.read_avi(f[: at + 8] + moved) == (seconds, frames)
        junk = b"JUNK" + (5).to_bytes(4, "little") + b"abcde\0"
        assert media.read_avi(f[:12] + junk + f[12:at])[1] == frames
    rows = [(1, files[0]), (2, files[0][: len(files[0]) // 3]), (3, files[1].replace(b"\xff\xc0", b"\xff\xc2"))]
    got = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame([(i, bytearray(f)) for i, f in rows], "doc_id long, media binary")).collect()}
    assert bytes(got[1]["payload"]).startswith(b"x" * 3000) and got[3]["payload"] is None
    clips = media.clip_rows(spark.createDataFrame([(1, bytearray(files[0])), (9, None)], "doc_id long, media binary")).collect()
    assert {r["doc_id"] for r in clips} == {1} and sum(r["n_frames"] for r in clips) == len(media.read_avi(files[0])[1]) and [r["shot"] for r in clips] == list(range(len(clips)))


def test_shots_by_force():
    """Cuts against the rule taken frame by frame, over several videos of noisy shots."""
    rng = np.random.default_rng(8)
    shares, lengths = [], [1, 40, 0, 25, 90]
    for n in lengths:
        level = rng.dirichlet(np.ones(media.HISTOGRAM_BINS))
        for _ in range(n):
            level = rng.dirichlet(np.ones(media.HISTOGRAM_BINS)) if rng.random() < 0.08 else level
            noisy = np.maximum(level + rng.normal(0, 0.01, level.shape), 0)
            shares.append(noisy / noisy.sum())
    first = np.concatenate(([0], np.cumsum(lengths)))
    got, want = media.cuts(np.array(shares), first), []
    for a, b in zip(first, first[1:]):
        change = [0.0] + [float(np.abs(shares[k] - shares[k - 1]).sum() / 2) for k in range(a + 1, b)]
        for k in range(b - a):
            past = change[max(1, k - media.WINDOW) : k]
            mean = sum(past) / max(1, len(past))
            spread = max(0.0, sum(c * c for c in past) / max(1, len(past)) - mean**2) ** 0.5
            want.append(k == 0 or (change[k] > media.LEAST_CHANGE and change[k] > mean + media.SPREADS * spread))
    assert got.tolist() == want and 4 < sum(want) < len(want) / 2


def test_media_broken_files(spark):
    rows = [(1, b"RIFF....", 2), (2, None, 2), (3, b"", 2)]
    got = media.read_media(spark.createDataFrame(rows, "doc_id long, media binary, clips int")).collect()
    assert all(r["payload"] is None and r["clips"] is None for r in got)


def test_licences(spark):
    texts = [
        "Released Under the MIT License, twice: under the mit license.", "Apache License, version 2", "cc-by-nc 4.0", None, "", "the mit under license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation", "under\nthe mit license",
    ]
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    base = [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for _, r in sorted(got.items())]
    assert base == [(2, 1, 6, "mit"), (1, 0, 0, "apache-2"), (1, 0, 0, "cc-by-nc"), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (0, None, None, ""), (1, 0, 0, "mit")]
    assert got[6]["labels"] == "mit" and 0.8 <= got[6]["score"] < 1 and got[0]["n_words"] == 10 and got[3]["n_words"] == 0


def test_licences_in_windows(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License"
    mit = "// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\r\n# modification, are permitted"
    rest = " filler" * 30
    scattered = rest.join("redistribution and use in source and binary forms with or without modification are permitted".split())
    texts = [gpl, mit, bsd, gpl.replace("\n", "\n\n"), f"{rest} {gpl}{rest} {mit} {mit}{rest} {bsd}{rest}".replace("\n", " "), scattered, "Licensed under CC BY 4.0", "Released under the BSD License", "licensed under cc by\nnc", bsd[:40]]
    texts += ["redistribution and use in source and binary", "forms with or without modification are permitted"]  # not across rows
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == ["gpl-3", "mit", "bsd-3", "gpl-3", "bsd-3,gpl-3,mit", "", "", "", "cc-by-nc", "", "", ""]
    places = {(b["label"], b["first_word"], b["n_words"], b["containment"]) for b in got[4]["blocks"]}
    assert places == {("gpl-3", 30, 22, 1.0), ("mit", 82, 20, 1.0), ("mit", 102, 20, 1.0), ("bsd-3", 152, 14, 1.0)}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_licence_places(threshold):
    """Places are where brute force over all windows finds one, over rows of few and many words."""
    rng = random.Random(5)
    template = licences._Template([3, 0, 4, 1, 4, 2, 5, 6], {1}, threshold)
    for _ in range(300):
        rows = [[rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 7]) for _ in range(rng.choice((0, 3, 12, 60)))] for _ in range(4)]
        first = np.cumsum([0] + [len(r) for r in rows])
        got = list(template.places(np.array([x for r in rows for x in r], np.int64), first))
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(got, got[1:]))
        for low, row in zip(first, rows):
            good = [i for i in range(len(row)) if 1 in (w := {*row[i : i + template.window]} - {7}) and len(w) >= template.need]
            mine = [(a - low, n, c) for a, n, c in got if low <= a < low + len(row)]
            assert bool(good) == bool(mine)
            for a, n, c in mine:
                w = {*row[a : a + n]} - {7}
                assert n <= template.window and 1 in w and len(w) >= template.need and c == len(w) / 7
            assert all(any(a < i + template.window and i < a + n for a, n, _ in mine) for i in good)


def test_pseudonyms(spark):
    texts = ["mail a.b@example.com or 4111 1111 1111 1111 on 2024-02-29", "again 4111-1111-1111-1111 and 2024-02-29, not 4111111111111112 or 2024-02-30", "ssn 123-45-6789, ip 10.1.2.3, +49 170 1234567", None, ""]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_pseudonyms int")
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    digits = lambda s: re.sub(r"\D", "", s)
    a, b = re.search(r"or ([\d ]{19}) on (\S+)", got[0]["text"]), re.search(r"again (\S+) and (\S{10}), not 4111111111111112 or 2024-02-30", got[1]["text"])
    assert digits(a[1]) == digits(b[1]) != "4111111111111111" and a[2] == b[2] != "2024-02-29"
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits(a[1])))))
    assert total % 10 == 0 and got[0]["n_pseudonyms"] == 3 and got[1]["n_pseudonyms"] == 2 and got[2]["n_pseudonyms"] == 3
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}, ip \d+\.\d+\.\d+\.\d+, \+49 \d{3} \d{7}", got[2]["text"])
    assert got[3]["text"] is None and got[3]["n_pseudonyms"] == 0 and got[4]["text"] == ""


def test_pseudonyms_beside_numbers(spark):
    """A card or IBAN is found whatever number or word stands beside it, and nothing beside it changes."""
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    shapes = ["{} 123", "{} 12/27", "order 12 {}", "3 {}", "2024 {} 99 1", "{} 2024-02-30", "{}-", "no {}, 7", "1 2 3 4 5 6 7 8 9 {}"]
    texts = [t.format(c) for c in (card, card.replace(" ", ""), card.replace(" ", "-"), "3782 822463 10005") for t in shapes]
    texts += [t.format(iban) for t in ("{} BIC", "{} EUR 12", "{}", "IBAN {} 0011", "{} GEBABEBB")] + [f"{card} {card}", f"{card} 123-45-6789", "1 2 3 4 " * 20000, "4111 1111 1111 1112 123", f"{card} 10.1.2.3"]
    got = [r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    same = {}
    for t, r in zip(texts[:41], got, strict=False):
        value = next(c for c in (card, card.replace(" ", ""), card.replace(" ", "-"), "3782 822463 10005", iban) if c in t)
        before, after = t.split(value)
        new = r["text"][len(before) : len(before) + len(value)]
        assert r["text"] == before + new + after and new != value and r["n_pseudonyms"] == 1, (t, r["text"])
        assert same.setdefault(re.sub("[ -]", "", value), re.sub("[ -]", "", new)) == re.sub("[ -]", "", new)
    assert [r["n_pseudonyms"] for r in got[41:]] == [2, 2, 0, 0, 2] and got[41]["text"][:19] == got[41]["text"][20:] and got[43]["text"] == texts[43] and got[44]["text"] == texts[44]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 32)).astype(np.float32)
    x[5] = x[9]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(700, None, 0), (720, [0.0] * 32, 0), (740, [float("nan")] * 32, 0), (None, [1.0] * 32, 0), (760, [], 0)]
    got = defaultdict(list)
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        exact = sorted(((-float(y[q] @ y[i]), i) for i in range(700) if i != q))[:20]
        hits += len({i for _, i in exact} & {i for i, _ in found})
        assert len(found) == 20 and all(abs(s - float(y[q] @ y[i])) < 1e-9 for i, s in found)
    assert hits >= 0.9 * 20 * len(got)


def _luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_are_permutations(spark):
    """Many values of each kind: valid ones get valid pseudonyms of the same shape, equal values equal ones, different values different ones."""
    import datetime

    rng, day = random.Random(11), datetime.date(1900, 1, 1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cards = [next(c for c in (body + str(k) for k in range(10)) if _luhn(c)) for body in {digits(15) for _ in range(300)} | {"411111111111111", "400000000000000"}]
    days = [day + datetime.timedelta(rng.randrange(73049)) for _ in range(300)]
    month_first = [d for d in days if d.day > 12]
    ibans = [f"DE{98 - int(b + '131400') % 97:02d}{b}" for b in {digits(18) for _ in range(200)}]
    kinds = {
        "card": [" ".join(c[i : i + 4] for i in range(0, 16, 4)) for c in cards], "bare card": cards, "iso": [d.isoformat() for d in days], "slashed": [d.strftime("%d/%m/%Y") for d in days], "dotted": [d.strftime("%d.%m.%Y") for d in days],
        "month": [d.strftime("%m/%d/%Y") for d in month_first], "iban": ibans, "ip": [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)], "national": [f"{rng.randint(2, 9)}{digits(2)}-{rng.randint(2, 9)}{digits(2)}-{digits(4)}" for _ in range(300)],
        "bracketed": [f"(0{digits(2)}) {digits(4)} {digits(4)}" for _ in range(200)], "ssn": [f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(300)],
        "key": ["AKIA" + "".join(rng.choice("ABCDEFGHIJ") for _ in range(16)) for _ in range(100)], "hex": ["".join(rng.choice("abcdef") for _ in range(40)) for _ in range(100)], "mail": [f"n{digits(3)}.{digits(2)}@x.org" for _ in range(200)],
    }
    rows = [(k, v) for k, vs in kinds.items() for v in vs]
    out = pii.pseudonymise(spark.createDataFrame([(i, v, "x", "y", "z") for i, (_, v) in enumerate(rows)], "doc_id long, text string, found string, `new` string, `key` string"), "k")
    assert out.columns == ["doc_id", "text", "found", "new", "key", "n_pseudonyms"] and out.first()["found"] == "x"
    got, per = {r["doc_id"]: r for r in out.collect()}, defaultdict(dict)
    for i, (kind, v) in enumerate(rows):
        new = got[i]["text"]
        assert got[i]["n_pseudonyms"] == (new != v) and [c.isdigit() for c in new] == [c.isdigit() for c in v] or kind in ("key", "mail", "hex", "ip"), (kind, v, new)
        assert per[kind].setdefault(v, new) == new and (len(new) == len(v) or kind == "ip")
    for kind, m in per.items():
        assert len(set(m.values())) == len(m) and sum(a != b for a, b in m.items()) > 0.95 * len(m), kind
    assert all(_luhn(new.replace(" ", "")) for k in ("card", "bare card") for new in per[k].values())
    assert all(per["card"][a].replace(" ", "") == per["bare card"][b] for a, b in zip(kinds["card"], cards))
    assert all(int(new[4:] + "1314" + new[2:4]) % 97 == 1 for new in per["iban"].values())
    moved = {d: datetime.date.fromisoformat(per["iso"][d.isoformat()]) for d in days}
    assert all(per["slashed"][d.strftime("%d/%m/%Y")] == e.strftime("%d/%m/%Y") and per["dotted"][d.strftime("%d.%m.%Y")] == e.strftime("%d.%m.%Y") for d, e in moved.items())
    assert all(int(new[3:5]) > 12 and datetime.datetime.strptime(new, "%m/%d/%Y") for new in per["month"].values())
    assert all(new[:4] == v[:4] and new[4] > "1" for v, new in per["national"].items())


def _nearest_by_force(rows, k=20):
    """Exact neighbours of the rows whose id is divisible by 20, ties to the smaller id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in zip(ids[ids % 20 == 0], x[ids % 20 == 0]):
        score = (x * q).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def _found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_nearest_of_copies(spark):
    """Copies of a vector stand in the index once and come out by id; doubles stay doubles; fewer rows than asked for are all returned."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((240, 16))
    x[20:130] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = _found(vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in _nearest_by_force(rows).items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q, v in _nearest_by_force(rows).items() for a, b in zip(v, got[q], strict=True))
    few = [(i, [float(i + 1), 1.0]) for i in range(0, 100, 20)] + [(7, [1.0, 2.0, 3.0])]
    assert _found(vectors.nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>"))) == _nearest_by_force(few[:5])


@pytest.mark.parametrize("kind", ["clusters", "lengths"])
def test_nearest_recall(spark, kind, monkeypatch):
    """Recall over many lists and blocks, for vectors in clusters and for vectors of very different lengths."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 100)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 500)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 24)).astype(np.float32)
    x = x * 0.3 + rng.standard_normal((40, 24)).astype(np.float32)[rng.integers(0, 40, 4000)] if kind == "clusters" else x * np.exp(rng.standard_normal((4000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    want, got = _nearest_by_force(rows), _found(vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.93 * 20 * len(want)
    assert vectors.fit_lists(x.astype(float), 4000, 20, 1, list_rows=100).probes < (12 if kind == "clusters" else 40)


def test_nearest_codes(spark):
    """On the test table the packed codes alone leave a small share of the rows for exact scoring, and find nine tenths of the neighbours."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    turn = vectors.rotation(x.shape[1], 5)
    code, length, fit = vectors.encode(x, turn)
    q = x[::20]
    estimate = vectors.Planes(q, turn).products(np.arange(len(q)), code) * (length / fit)
    plain = (q @ turn.T) @ np.where(x @ turn.T > 0, 1, -1).T / np.sqrt(x.shape[1]) * (length / fit)
    assert np.abs(estimate - plain).max() < 0.1
    error = vectors.ERROR_SCALE * length * np.sqrt((1 - fit**2) / fit**2 / (x.shape[1] - 1)) * np.linalg.norm(q, axis=1)[:, None]
    exact = q @ x.T
    kth = np.sort(exact, axis=1)[:, -21]
    looked_at = estimate + error >= kth[:, None]
    assert looked_at.mean() < 0.3 and (looked_at & (exact >= kth[:, None])).sum() >= 0.95 * 21 * len(q)
    want, got = _nearest_by_force([(r["vec_id"], r["embedding"]) for r in rows]), _found(vectors.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(("the", "river", "quiet", "House", "walks", "slowly.")) for _ in range(60))
    junk = lambda: " ".join(rng.choice(("$$$", "!!!", "buy###", "x%%", "CLICK")) for _ in range(60))
    rows = [(i, good() if i % 2 else junk()) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 400]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect() if r["doc_id"] < 400} == {i for i in range(400) if i % 2}


def test_quality_of_held_out_rows(spark):
    """On the test tables, labelled documents that were never fitted are told apart."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    scores = quality.score_documents(docs, labels).where("held_out").join(labels.where("quality IN (0, 1)").dropDuplicates(["doc_id"]), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in scores if r["quality"] == k] for k in (1, 0))
    assert min(len(good), len(bad)) > 10
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_trees_by_force():
    """Flattened trees give what walking them node by node gives."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 4))
    forest = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=6, depth=3)
    for row, got in zip(x, forest.margin(x), strict=True):
        total = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - got) < 1e-9


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    runs = [
        quality.score_documents(docs, labels), quality.keep_good(docs, labels), line_dedup.dedup_lines(docs), media.read_media(media.write_media(docs)), mixing.mix(docs), mixing.shard_rows(mixing.mix(docs)), mixing.mixed_texts(docs),
        packing.pack(docs, tokenizer_path()), ngram_join.join_components(docs), ngram_join.one_of_each(docs), licences.scan_licences(docs), pii.pseudonymise(docs, "k"), suffix_dedup.remove_repeats(docs), vectors.nearest(vecs),
    ]
    assert [df.count() for df in runs] == [0] * len(runs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_nulls(spark):
    """Stages of the pipeline over rows with nulls everywhere, repeats and a very long text: nothing crashes, and rows without a text or an id stay where nothing speaks against them."""
    import corpus_pipeline

    word = " ".join(f"word{k % 977} and then" for k in range(40000))
    rows = [(None, None, None, None, None), (1, None, None, None, None), (None, "a text", "en", "s", 6), (2, word, "en", "s", len(word)), (2, word, "en", "s", len(word)), (3, "", None, "t", 0), (4, word[:-9], "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = ngram_join.one_of_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "2", "3", "None", "None"]
    assert {r["doc_id"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {None, 1, 2, 3, 4}
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert {r["source"] for r in mixed} <= {None, "s", "t"} and all(r["text"] for r in mixed)
    pieces = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(corpus_pipeline.STAGES) == 5 and rows
    tokens = Counter()
    for r in rows:
        tokens[r["sequence_id"]] += r["length"]
    assert max(tokens.values()) <= 2048
    assert len({hashlib.sha256(bytes(r["ids"])).hexdigest() for r in rows}) > 1
