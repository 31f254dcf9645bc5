"""The uuid in a document's YAML frontmatter."""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from linkgraph.functions.paths import BLANK

_HEAD = rf"(?s)\A(---[{BLANK}]*\n).*?---[{BLANK}]*\n"
#: A block of exactly one plain uuid line, which needs no YAML parser.
_SIMPLE = r"\A---\n(?:[A-Za-z_]+: [A-Za-z]+\n)*uuid: ([0-9a-f]*[a-f][0-9a-f]*-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\n---\n"
_BOUNDARY = re.compile(r"^-{3,}\s*$", re.MULTILINE)


def has_frontmatter(text: Column) -> Column:
    """Begins with ``---``, and another ``---`` at the end of a line follows."""
    return text.rlike(_HEAD)


def _read(text: str) -> tuple[str, str | None]:
    parts = _BOUNDARY.split(text.strip(), maxsplit=2)
    try:
        meta = yaml.safe_load(parts[1]) if len(parts) == 3 else {}
    except Exception:
        return "invalid", None
    uuid = meta.get("uuid") if isinstance(meta, dict) else None
    if uuid is not None and not isinstance(uuid, str):
        return "invalid", None
    return "valid", (uuid or "").strip().lower() or None


@pandas_udf(StructType([StructField("status", StringType()), StructField("uuid", StringType())]))
def _read_yaml(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else _read(x) for x in texts], columns=["status", "uuid"])


def read_uuid(text: Column) -> Column:
    """struct<status, uuid>: none without a block, invalid if it is no YAML or uuid is no string, else valid with the uuid in lower case or null.

    Only blocks that aren't plainly one uuid line go through a YAML parser, outside the JVM.
    """
    simple = F.regexp_extract(text, _SIMPLE, 1)
    found = _read_yaml(F.when((simple == "") & has_frontmatter(text), text))
    status = F.when(simple != "", F.lit("valid")).when(found["status"].isNotNull(), found["status"]).otherwise(F.lit("none"))
    return F.struct(status.alias("status"), F.when(simple != "", simple).otherwise(found["uuid"]).alias("uuid"))


def plain_uuid(text: Column) -> Column:
    """The first line ``uuid: ...`` of the block, in lower case and without quotes, whatever YAML makes of the block; null without one."""
    block = F.regexp_extract(text, rf"(?s)\A---[{BLANK}]*\n(.*?)---[{BLANK}]*\n", 1)
    found = F.regexp_extract(block, r"(?m)^uuid:[ \t]*(\S.*?)[ \t]*$", 1)
    bare = F.lower(F.regexp_replace(found, "^['\"]+|['\"]+$", ""))
    return F.when(bare != "", bare)


def newline(text: Column) -> Column:
    return F.when(text.contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n"))


def head_length(text: Column) -> Column:
    """Characters of the block's opening line; 0 without a block."""
    return F.char_length(F.regexp_extract(text, _HEAD, 1))


def uuid_insertion(head: Column, has_block: Column, newline: Column, uuid: Column) -> Column:
    """The edit struct<s, e, r> that gives a document a uuid: after the opening line of its block, or as a new block."""
    line = F.concat(F.lit("uuid: "), uuid, newline)
    block = F.concat(F.lit("---"), newline, line, F.lit("---"), newline, newline)
    return F.struct(head.alias("s"), head.alias("e"), F.when(has_block, line).otherwise(block).alias("r"))
