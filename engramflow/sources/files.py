"""Reading files of text and JSON into blocks, and their logical keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = (".txt", ".md", ".json", ".jsonl")
_CONTROL = re.compile(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]")
_LABEL = re.compile(r"^\s*([^\s:：][^:：\n]{0,38})[:：]\s*\S", re.M)
_HARD = re.compile(r"^\s*(#{1,6}\s|[-*_=]{3,}\s*$)")
_DIRECTIVE = re.compile(r"\[\[memory (\{.*?\})\]\]", re.S)
_TAG = re.compile(r"<[^>]*>|\[/?[a-z][a-z0-9_=#]*\]")


def natural_key(path: Column) -> Column:
    """A string that orders paths as people do: digits are zero-padded to twenty places."""
    parts = F.split(F.regexp_replace(F.lower(path), r"(\d+)", "\u0000$1\u0000"), "\u0000")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def logical_key(path: Column, root: str) -> Column:
    """The path below the root, with forward slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")


def timeline_scope(key: Column) -> Column:
    """Lower-cased parent folders joined by colons, or root."""
    folders = F.slice(F.split(F.lower(key), "/"), F.lit(1), F.greatest(F.size(F.split(key, "/")) - 1, F.lit(0)))
    return F.when(F.size(folders) == 0, "root").otherwise(F.array_join(folders, ":"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files below root: path, source_key, supported, content, in natural order of their keys."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = logical_key(F.col("path"), root)
    return files.select("path", key.alias("source_key"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUPPORTED).alias("supported"), "content").orderBy(natural_key(key))


def decode(content: bytes) -> str:
    """Text of bytes: by byte order mark (UTF-32, UTF-16, UTF-8), else UTF-8, else GB 18030; control bytes are refused."""
    for mark, name in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name)
    if _CONTROL.search(content):
        raise ValueError("control bytes in text")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("gb18030")


def strict_json(text: str):
    """JSON without repeated keys and without NaN or infinities."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def clean(text: str) -> str:
    """Tags out, [USERNAME] kept, white space collapsed."""
    kept = text.replace("[USERNAME]", "\u0000")
    return " ".join(_TAG.sub(" ", kept).split()).replace("\u0000", "[USERNAME]")


def is_dialogue(text: str) -> bool:
    """Three labelled lines or more, and either a label comes again or they are two fifths of the lines."""
    labels = [m[1].strip() for m in _LABEL.finditer(text)]
    lines = [x for x in text.split("\n") if x.strip()]
    return len(labels) >= 3 and (len(set(labels)) < len(labels) or len(labels) >= 0.4 * len(lines))


def text_blocks(text: str) -> list[dict]:
    """Blocks of a text or Markdown file: paragraphs between blank lines, or labelled lines of a dialogue; headings and rules are hard
    boundaries; [[memory {...}]] sets attributes of the block it stands in."""
    parts = text.split("\n") if is_dialogue(text) else re.split(r"\n[ \t]*\n", text)
    out = []
    for p in parts:
        if not p.strip():
            continue
        attributes = {}
        for m in _DIRECTIVE.finditer(p):
            attributes |= strict_json(m[1])
        body = _DIRECTIVE.sub("", p).strip()
        speaker = _LABEL.match(body)
        if body:
            out.append({"text": body, "boundary": 3 if _HARD.match(body) else 0, "section": "", "speaker": speaker[1].strip() if speaker and is_dialogue(text) else "", "attributes": json.dumps(attributes, sort_keys=True)})
    return out


def json_blocks(value, path: tuple = ()) -> list[dict]:
    """Every text of any nested JSON, with its path as a section."""
    if isinstance(value, dict):
        return [b for k, v in value.items() for b in json_blocks(v, (*path, str(k)))]
    if isinstance(value, list):
        return [b for v in value for b in json_blocks(v, path)]
    text = clean(value) if isinstance(value, str) else ""
    return [{"text": text, "boundary": 0, "section": " / ".join(path), "speaker": "", "attributes": "{}"}] if text else []


BLOCKS = "source_key string, position long, text string, boundary int, section string, speaker string, attributes string, error string"


def read_blocks(files: DataFrame) -> DataFrame:
    """files: source_key, content -> BLOCKS; a file that can't be read gives one row with the error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, content in zip(pdf["source_key"], pdf["content"]):
                try:
                    text = decode(bytes(content)).replace("\r\n", "\n")
                    found = json_blocks(strict_json(text)) if key.lower().endswith(".json") else text_blocks(text)
                    rows += [(key, k, b["text"], b["boundary"], b["section"], b["speaker"], b["attributes"], None) for k, b in enumerate(found)]
                except (ValueError, UnicodeError) as e:
                    rows.append((key, 0, None, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_key", "position", "text", "boundary", "section", "speaker", "attributes", "error"])

    return files.select("source_key", "content").mapInPandas(run, BLOCKS)
