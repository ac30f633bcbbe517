"""Instrument and worksheet files as relations. Files are read by Spark, so any store it reaches will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import coerce, initial_caps


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """file, path (array of names), value struct<i, f, s>, part: settings of lines ``:A:B:C value``; commas part a list."""
    lines = spark.read.text(path, wholetext=False).withColumn("file", F.col("_metadata.file_path"))
    line = F.regexp_extract("value", r"^:(\S+)\s+(.*)$", 0)
    rows = lines.withColumn("_p", F.regexp_extract("value", r"^:(\S+)\s+(.*)$", 1)).withColumn("_v", F.regexp_extract("value", r"^:(\S+)\s+(.*)$", 2)).where(line != "")
    names = F.transform(F.split("_p", ":"), initial_caps)
    return rows.select("file", names.alias("path"), F.posexplode(F.split("_v", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")).alias("part", "_one")).select("file", "path", "part", coerce(F.trim("_one")).alias("value"))


def read_old_settings(spark: SparkSession, path: str) -> DataFrame:
    """file, section, key, value: text led by a colon, sections apart by ``;:``, records by ``;``."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    parts = whole.select("file", F.explode(F.split(F.regexp_replace("value", r"^[^:]*:", ""), ";:")).alias("_s"))
    parts = parts.withColumn("section", F.element_at(F.split("_s", ":"), 1)).withColumn("_r", F.regexp_replace("_s", r"^[^:]*:", ""))
    rows = parts.select("file", "section", F.explode(F.split("_r", ";")).alias("_k"))
    return rows.select("file", initial_caps(F.col("section")).alias("section"), initial_caps(F.element_at(F.split("_k", " "), 1)).alias("key"), coerce(F.trim(F.regexp_replace("_k", r"^\S+\s*", ""))).alias("value"))


def waveform(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of a waveform file with a text header and a counted block of signed bytes."""
    mark = re.search(rb":CURVE? #(\d)", raw)
    if not mark:
        raise ValueError("no curve in the file")
    at = mark.end() + int(mark[1])
    n = int(raw[mark.end() : at])
    info = {}
    for record in raw[: mark.start()].decode("latin-1").replace(":", ";").split(";"):
        key, _, value = record.strip().partition(" ")
        if value:
            info[key.capitalize()] = value
    y = np.frombuffer(raw[at : at + n], np.int8).astype(float)
    scale = {k: float(info[k]) for k in ("Xin", "Xze", "Yof", "Ymu", "Yze")}
    return np.arange(len(y)) * scale["Xin"] + scale["Xze"], (y - scale["Yof"]) * scale["Ymu"] + scale["Yze"]


def read_waveforms(spark: SparkSession, path: str | list[str], resample: int | None = None) -> DataFrame:
    """file, i, t, x of every waveform file; with ``resample`` means of so many samples, a short rest left out. A task holds one file at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                t, y = waveform(bytes(raw))
                if resample is not None:
                    n = len(t) // resample * resample
                    t, y = (v[:n].reshape(-1, resample).mean(1) for v in (t, y))
                yield pd.DataFrame({"file": name, "i": np.arange(len(t)), "t": t, "x": y})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, i long, t double, x double")


def read_scope(spark: SparkSession, prefix: str, resample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(channel, i, t, x) of one capture, and its settings: ``<prefix>.SET`` says which channels are on, ``<prefix>CH<k>.ISF`` hold them."""
    prefix = prefix[:-4] if prefix.endswith(".SET") else prefix
    settings = read_settings(spark, prefix + ".SET")
    switch = settings.where((F.element_at("path", 1) == "Select") & F.element_at("path", -1).rlike("^Ch[0-9]+$") & (F.coalesce("value.i", F.lit(0)) > 0))
    on = sorted(int(r["c"]) for r in switch.select(F.regexp_extract(F.element_at("path", -1), "([0-9]+)", 1).alias("c")).distinct().collect())  # channels of an instrument
    if not on:
        raise ValueError("no channel is on")
    waves = read_waveforms(spark, [f"{prefix}CH{k}.ISF" for k in on], resample)
    return waves.select(F.regexp_extract("file", r"CH(\d+)\.ISF$", 1).cast("int").alias("channel"), "i", "t", "x"), settings


def read_scope_csv(spark: SparkSession, path: str) -> DataFrame:
    """file, channel, i, t, x of a folder's ``*.CSV``: columns 3 and 4 are time and level; the channel is the digit before the suffix.

    A file is one record of an instrument, small beside a task, and is read whole, so its rows keep their order.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("_n", "_l"))
    cell = F.split("_l", ",")
    rows = lines.select("file", F.regexp_extract("file", r"(?i)(\d)\.CSV$", 1).try_cast("int").alias("channel"), "_n", F.trim(F.get(cell, F.lit(3))).try_cast("double").alias("t"), F.trim(F.get(cell, F.lit(4))).try_cast("double").alias("x"))
    i = F.row_number().over(Window.partitionBy("file").orderBy("_n")) - 1
    return rows.where("t IS NOT NULL AND x IS NOT NULL").select("file", "channel", i.cast("long").alias("i"), "t", "x")


def read_scope_settings(spark: SparkSession, path: str) -> DataFrame:
    """file, key, value of a folder's ``*.CSV``: columns 0 and 1 of the rows that name a setting."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = whole.select("file", F.explode(F.split("value", r"\r?\n")).alias("_l"))
    cell = F.split("_l", ",")
    return lines.select("file", F.trim(F.get(cell, F.lit(0))).alias("key"), coerce(F.trim(F.get(cell, F.lit(1)))).alias("value")).where("key <> ''")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def worksheet_cells(raw: bytes, sheet: int = 1) -> list[tuple[int, int, str | None, float | None]]:
    """(row, column, text, number) of a workbook's sheet, from 1."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for c in root.iter(f"{{{_NS['m']}}}c"):
        letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
        column = 0
        for ch in letters:
            column = column * 26 + ord(ch) - 64
        v, kind = c.find("m:v", _NS), c.get("t")
        if kind == "inlineStr":
            out.append((int(digits), column, "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), None))
        elif v is not None and kind == "s":
            out.append((int(digits), column, shared[int(v.text)], None))
        elif v is not None:
            text = v.text if kind in ("str", "b", "e") else None
            out.append((int(digits), column, text, None if text is not None else float(v.text)))
    return out


def read_cells(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """file, r, c, s, v of every cell of workbooks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                yield pd.DataFrame([(name, *x) for x in worksheet_cells(bytes(raw), sheet)], columns=["file", "r", "c", "s", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, r int, c int, s string, v double")


def find_cell(cells: DataFrame, needle: str | float) -> DataFrame:
    """file, r, c of the first cell, by rows, that holds the text or the number."""
    same = F.col("s") == needle if isinstance(needle, str) else F.col("v") == float(needle)
    return cells.where(same).groupBy("file").agg(F.min(F.struct("r", "c")).alias("at")).select("file", "at.r", "at.c")


def table_at(cells: DataFrame, row: int, column: int) -> DataFrame:
    """file, r, name, s, v: the table whose header begins at a cell, to the header's first blank and the first blank key."""
    head = cells.where((F.col("r") == row) & (F.col("c") >= column)).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("c", F.coalesce("s", F.col("v").cast("string"))))).alias("_h"))
    width = F.aggregate(F.sequence(F.lit(column), F.lit(column + 16383)), F.lit(column), lambda n, k: F.when((n == k) & F.col("_h")[k].isNotNull(), n + 1).otherwise(n))
    keys = cells.where((F.col("r") > row) & (F.col("c") == column)).groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("_r"))
    depth = F.aggregate(F.col("_r"), F.lit(row), lambda n, k: F.when(k == n + 1, k).otherwise(n))
    bounds = head.withColumn("_w", width).join(keys.withColumn("_d", depth), "file")
    inside = cells.join(bounds, "file").where((F.col("r") > row) & (F.col("r") <= F.col("_d")) & (F.col("c") >= column) & (F.col("c") < F.col("_w")))
    return inside.select("file", "r", F.col("_h")[F.col("c")].alias("name"), "s", "v")


def octave_text(text: str) -> list[tuple[str, str, str]]:
    """(path, type, JSON value) of the variables of an Octave text file; fields and cells have paths of their own."""
    import json

    lines, out = text.split("\n"), []

    def head(k: int, word: str) -> str | None:
        m = re.match(rf"# {word}: ?(.*)", lines[k]) if k < len(lines) else None
        return m[1] if m else None

    def number(s: str):
        f = float(s)
        return int(f) if f.is_integer() and abs(f) < 2**53 else f

    def value(k: int, path: str) -> int:
        while head(k, "type") is None:
            k += 1
        kind, k = head(k, "type"), k + 1
        if kind.endswith("complex scalar"):
            out.append((path, kind, json.dumps([float(x) for x in lines[k].strip("() ").split(",")])))
            return k + 1
        if kind.endswith("scalar struct") or kind == "struct":
            while head(k, "length") is None:
                k += 1
            n, k = int(head(k, "length")), k + 1
            for _ in range(n):
                while head(k, "name") is None:
                    k += 1
                k = value(k + 1, f"{path}.{head(k, 'name')}")
            return k
        if kind.endswith("scalar") or kind == "bool":
            out.append((path, kind, json.dumps(number(lines[k].strip()))))
            return k + 1
        if kind in ("sq_string", "string"):
            n, k = int(head(k, "elements")), k + 1
            parts = []
            for _ in range(n):
                size = int(head(k, "length"))
                parts.append(lines[k + 1][:size] if size else "")
                k += 2 if size else 1
            out.append((path, kind, json.dumps(parts[0] if n == 1 else parts)))
            return k
        if kind == "cell":
            rows, columns, k = int(head(k, "rows")), int(head(k + 1, "columns")), k + 2
            for c in range(columns):
                for r in range(rows):
                    while head(k, "name") is None:
                        k += 1
                    k = value(k + 1, f"{path}{{{r},{c}}}")
            return k
        if kind.endswith("matrix"):
            if head(k, "ndims") is not None:
                shape, k = [int(x) for x in lines[k + 1].split()], k + 2
                flat = [number(lines[k + i].strip()) for i in range(int(np.prod(shape)))]
                out.append((path, kind, json.dumps(np.array(flat).reshape(shape, order="F").tolist())))
                return k + len(flat)
            n, k = int(head(k, "rows")), k + 2
            rows = [[number(x) for x in lines[k + r].split()] for r in range(n)]
            out.append((path, kind, json.dumps(rows[0] if n == 1 else rows)))
            return k + n
        raise ValueError(f"{path}: type {kind} is not read")

    k = 0
    while k < len(lines):
        name = head(k, "name")
        k = value(k + 1, name) if name is not None else k + 1
    return out


def read_octave_text(spark: SparkSession, path: str) -> DataFrame:
    """file, path, type, value (variant) of every variable, field and cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                yield pd.DataFrame([(name, *x) for x in octave_text(bytes(raw).decode("utf-8", "replace"))], columns=["file", "path", "type", "json"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, path string, type string, json string")
    return rows.select("file", "path", "type", F.parse_json("json").alias("value"))
