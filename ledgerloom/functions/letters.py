"""Capital letters, as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that have one capital by simple case mapping, where full mapping gives two letters; the sharp s has one that stays as it is.
_ONE = {0x1FB3: 0x1FBC, 0x1FC3: 0x1FCC, 0x1FF3: 0x1FFC} | {c: c + 8 for row in (0x1F80, 0x1F90, 0x1FA0) for c in range(row, row + 8)}
_SHARP_S, _CAPITAL_SHARP_S = "ß", "ẞ"
#: Other letters that Spark's upper() doesn't map one by one: these, such as have no capital of their own, and such as came with Unicode 16.
_OTHER = """149 19b 1f0 264 390 3b0 587 1c8a 1e96-1e9a 1f50 1f52 1f54 1f56 1f80-1faf 1fb2-1fb4 1fb6-1fb7 1fbc 1fc2-1fc4 1fc6-1fc7 1fcc 1fd2-1fd3 1fd6-1fd7 1fe2-1fe4
    1fe6-1fe7 1ff2-1ff4 1ff6-1ff7 1ffc a7cd a7db fb00-fb06 fb13-fb17 10d70-10d85"""
#: One comparison tells most letters from these.
_CLASS = "[\\x{149}-\\x{10ffff}&&[" + "".join("-".join(f"\\x{{{c}}}" for c in r.split("-")) for r in _OTHER.split()) + "]]"


def capitals(text: Column) -> Column:
    """Each letter's own capital, as DuckDB's upper() has it: as many letters as before, while Spark's upper() makes two of some (a sharp s becomes SS)."""
    text = F.replace(text, F.lit(_SHARP_S), F.lit(_CAPITAL_SHARP_S))
    other = F.translate(F.array_join(F.regexp_extract_all(text, F.lit(_CLASS), F.lit(0)), ""), *("".join(map(chr, c)) for c in (_ONE, _ONE.values())))
    whole = F.zip_with(F.split(text, _CLASS), F.split(other, ""), lambda a, b: F.concat(F.upper(a), F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(_CLASS), F.array_join(whole, "")).otherwise(F.upper(text))
