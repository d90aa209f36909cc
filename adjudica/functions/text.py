"""Text and hash scalars (B17, B22-B26, B35). Unicode normal forms and case folding have no built-in, so those two are
Arrow-batched; all else is built in."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# fixed values: upper bounds (exclusive) of the hash bucket for each split
BUCKETS = {"train": 60, "development": 75, "calibration": 85}
LAST_SPLIT = "locked_test"


@pandas_udf(StringType())
def canonical_state(state: pd.Series) -> pd.Series:
    """JSON with sorted keys and no white space, any other text as it is; NFC. Null stays null."""

    def one(x):
        if x is None:
            return None
        if x[:1] in ("{", "["):
            try:
                x = json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (ValueError, RecursionError):
                pass
        return unicodedata.normalize("NFC", x)

    return state.map(one, na_action="ignore")


def _values(x, path: str = ""):
    """(lower-cased path, text) of every scalar of parsed JSON."""
    if isinstance(x, dict):
        for k, v in x.items():
            yield from _values(v, f"{path}.{k.lower()}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from _values(v, f"{path}.{i:09d}")
    else:
        yield path, x if isinstance(x, str) else json.dumps(x)


def _decision_text(state: str) -> str:
    if state.lstrip()[:1] != "{":
        return state
    try:
        values = sorted(_values(json.loads(state)))
    except (ValueError, RecursionError):
        return state
    named = dict(values)
    if ".essay" in named:
        return named[".essay"]
    if ".question" in named and ".candidate_sentence" in named:
        return named[".question"] + " " + named[".candidate_sentence"]
    return " ".join(v for _, v in values)


@pandas_udf(StringType())
def decision_text(state: pd.Series) -> pd.Series:
    """What a state puts up for decision: of a JSON object its essay, or question and candidate sentence; of any other object
    all values in order of their paths; any other state as it is (C1). Half surrogates of JSON escapes become U+FFFD."""
    sound = lambda x: x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return state.map(lambda x: sound(_decision_text(x)), na_action="ignore")


@pandas_udf(StringType())
def duplicate_key(text: pd.Series) -> pd.Series:
    """Words of the NFKC form, case folded, joined by a space (B22). Words are split here too: Java's ``\\w`` takes combining
    marks and joiners for letters, the reference does not."""
    return text.map(lambda x: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", x).casefold())), na_action="ignore")


def plain(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def stable_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def bucket(seed: str, key: Column) -> Column:
    """The first 64 bits of SHA-256 of ``seed NUL key`` modulo 100."""
    head = F.substring(F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % 100).cast("int")


def split_of(b: Column) -> Column:
    out = F
    for name, top in BUCKETS.items():
        out = out.when(b < top, name)
    return out.otherwise(LAST_SPLIT)


def number_text(x: Column) -> Column:
    """At most six decimals, trailing zeros off; very small numbers in exponent form."""
    fixed = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when((F.abs(x) < 1e-4) & (x != 0), F.format_string("%.3e", x)).otherwise(fixed)
