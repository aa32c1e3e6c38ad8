"""Scripts of dialogues in JSON: records with a script command, texts by language, and marks of scene boundaries.

    spark.dataSource.register(DialogueSource)
    spark.read.format("dialogue").load(folder)                 # one partition a file, for folders that all workers mount
    dialogue_records(spark.read.format("binaryFile").load(...)) # any store that Spark reads

Both give RECORDS, one row for every record, or one with an error for a file that is no dialogue. ``blocks`` makes of them what is told: speakers and Korean text come from
the scripts, records without text go, and the strongest boundary since the last block that was told is carried on to the next one.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import decode, logical_key, strict_json

#: Fields of the texts by language, commands of previews and of the display, marks in texts that are taken out.
LANGUAGES = {"zh-CN": "TextCn", "ja": "TextJp", "en": "TextEn", "zh-TW": "TextTw", "th": "TextTh"}
PREVIEW, CONTROL = r"(?i)^\s*#nextepisode(?:;[^\r\n]*)?\s*$", r"(?i)^\s*#(?:st(?:;[^\r\n]*)?|clearst)\s*$"
MARKS = r"(?i)\[/?ruby(?:=[^\]]+)?\]|\[(?:[0-9a-f]{6}|-)\]"
RECORDS = "source_key string, record_index long, script string, languages map<string,string>, transition boolean, background boolean, group_id string, error string"
_ARROW = pa.schema([("source_key", pa.string()), ("record_index", pa.int64()), ("script", pa.string()), ("languages", pa.map_(pa.string(), pa.string())), ("transition", pa.bool_()), ("background", pa.bool_()), ("group_id", pa.string()), ("error", pa.string())])


def records_of(key: str, content: bytes) -> list[tuple]:
    """Rows of RECORDS of a file; the texts are as they stand."""
    try:
        whole = strict_json(decode(content))
    except (ValueError, UnicodeError) as e:
        return [(key, 0, None, None, None, None, None, f"{type(e).__name__}: {e}")]
    content = whole.get("content") if isinstance(whole, dict) else None
    fields = {"ScriptKr", *LANGUAGES.values()}
    if not isinstance(content, list) or not any(isinstance(r, dict) and fields & r.keys() for r in content):
        return [(key, 0, None, None, None, None, None, "no dialogue")]
    out = []
    for k, r in enumerate(content):
        if isinstance(r, dict):
            texts = {lang: str(r.get(field) or "") for lang, field in LANGUAGES.items() if r.get(field)}
            group = r.get("GroupId", whole.get("GroupId"))
            out.append((key, k, str(r.get("ScriptKr", "")), texts, bool(r.get("Transition")), bool(r.get("BGName")), None if group is None else group if isinstance(group, str) else json.dumps(group), None))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    arrays = [pa.array([None if v is None else list(v.items()) for v in c] if f.name == "languages" else list(c), f.type) for c, f in zip(columns, _ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def dialogue_records(files: DataFrame) -> DataFrame:
    """files: source_key, content."""

    def run(batches):
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield _batch(records_of(key, content.as_py() or b""))

    return files.select("source_key", "content").mapInArrow(run, RECORDS)


class _File(InputPartition):
    def __init__(self, key: str, path: str):
        super().__init__(key)
        self.key, self.path = key, path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = [os.path.join(top, name) for top, _, names in os.walk(self.folder) for name in names if name.lower().endswith(".json")]
        return [_File(os.path.relpath(p, self.folder).replace(os.sep, "/"), p) for p in sorted(found)]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            content = f.read()
        yield _batch(records_of(partition.key, content))


class DialogueSource(DataSource):
    """The format ``dialogue``: JSON files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "dialogue"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("dialogue needs a path")
        return _Reader(path)


def clean(c: Column) -> Column:
    """Ruby and colour marks out, [USERNAME] kept, white space collapsed."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), MARKS, "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)\s+", " "), "^ | $", "")


def _cell(line: Column, n: int, rest: bool = False) -> Column:
    """The n-th cell (from 0) of a command, with all that follows if rest; null if there are fewer."""
    found = rf"^(?:[^;]*;){{{n}}}" + ("(.*)$" if rest else "([^;]*)")
    return F.when(line.rlike(found), F.regexp_extract(line, found, 1))


def _lines(script: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(script, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def _first(found: Column) -> Column:
    held = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.element_at(held, 1))


def _narrated(line: Column) -> Column:
    return line.startswith("#na;") & (clean(_cell(line, 2, True)) != "")


def _spoken(line: Column) -> Column:
    return line.rlike("^[0-9]+;") & (clean(_cell(line, 3, True)) != "")


def speaker(script: Column) -> Column:
    """Who speaks the first line with text; without any, the first who is shown; else empty."""
    named = lambda x: F.when(_narrated(x), clean(_cell(x, 1))).when(_spoken(x) & (F.trim(_cell(x, 1)) != ""), clean(_cell(x, 1)))
    shown = lambda x: F.when(x.rlike("^[0-9]+;") & (F.trim(_cell(x, 1)) != ""), F.nullif(clean(_cell(x, 1)), F.lit("")))
    return F.coalesce(_first(F.transform(_lines(script), named)), _first(F.transform(_lines(script), shown)), F.lit(""))


def korean(script: Column) -> Column:
    """The first text of a script: narrated, spoken, or a title's or place's."""
    titled = lambda x: x.startswith("#title;") | x.startswith("#place;")
    said = lambda x: F.when(_narrated(x), clean(_cell(x, 2, True))).when(_spoken(x), clean(_cell(x, 3, True))).when(titled(x), clean(_cell(x, 1, True)))
    return F.coalesce(_first(F.transform(_lines(script), said)), F.lit(""))


def boundary(script: Column, transition: Column, background: Column) -> Column:
    """How strong a scene boundary a record is: 3 for transitions, 2 for a new background or menu and for long waits, 1 for others, else 0."""
    wait = F.regexp_extract(script, r"^#wait;\s*([+-]?[0-9]+)\s*$", 1)
    whole = script.rlike(r"^#wait;\s*[+-]?[0-9]+\s*$")
    has = lambda text: F.contains(script, F.lit(text))
    return (
        F.when(transition | has("#all;hide"), 3)
        .when(background | has("#showmenu") | has("#hidemenu"), 2)
        .when(script.startswith("#wait;"), F.when(whole & (wait.try_cast("long") >= 2000), 2).otherwise(1))
        .otherwise(0)
    )


def blocks(records: DataFrame) -> DataFrame:
    """source_key, record_index, speaker, languages (texts cleaned, empty ones out), korean, boundary, group_id of the records that tell something.

    Previews of a next episode, which also end a scene, records without text and commands to the display are not told; what boundary they are is carried on."""
    script = F.col("script")
    rows = records.where("error IS NULL").withColumn("languages", F.map_filter(F.transform_values("languages", lambda k, v: clean(v)), lambda k, v: v != ""))
    rows = rows.withColumn("korean", korean(script)).withColumn("preview", script.rlike(PREVIEW))
    only_control = F.forall(F.map_values("languages"), lambda v: v.rlike(CONTROL)) & (F.col("korean") == "")
    told = ~F.col("preview") & (F.size("languages") > 0) & ~only_control
    own = F.greatest(boundary(script, F.col("transition"), F.col("background")), F.when(F.col("preview"), 3).otherwise(0))
    order = Window.partitionBy("source_key").orderBy("record_index")
    held = rows.withColumn("told", told).withColumn("own", own).withColumn("run", F.coalesce(F.sum(F.col("told").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carried = held.withColumn("boundary", F.max("own").over(Window.partitionBy("source_key", "run")))
    return carried.where("told").select("source_key", "record_index", speaker(script).alias("speaker"), "languages", "korean", "boundary", "group_id")


def read(spark, root: str) -> DataFrame:
    """Blocks of all dialogues below a folder of any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,JSON}").load(root)
    return blocks(dialogue_records(files.select(logical_key(F.col("path"), root).alias("source_key"), "content")))
