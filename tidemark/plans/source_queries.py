"""Registered queries of the sources: fixtures made from the tables are written to the shared folder, read back and compared with the tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import bags, instruments, store
from ..streaming.hysteresis import schmitt_stream
from . import series as R
from .registry import query


@query("source_settings", "SELECT s_suppkey, s_acctbal AS value, s_name AS label, CAST(s_nationkey + 1 AS BIGINT) AS second FROM supplier")
def source_settings(spark, d):
    """Three lines for each supplier: a number, a quoted label with a comma, and a list."""
    s = R.table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    lines = F.array(F.concat(F.lit(":SUP"), k, F.lit(":BAL "), F.col("s_acctbal").cast("string")), F.concat(F.lit(":SUP"), k, F.lit(':LABEL "'), "s_name", F.lit('"')), F.concat(F.lit(":SUP"), k, F.lit(":LIST "), F.col("s_nationkey").cast("string"), F.lit(","), (F.col("s_nationkey") + 1).cast("string")))
    path = store.shared_folder(spark)
    s.select(F.explode(lines).alias("value")).write.text(path)
    rows = instruments.read_settings(spark, path).withColumn("s_suppkey", F.regexp_extract(F.col("path")[0], "([0-9]+)", 1).cast("long"))
    pick = lambda name, part, v: F.max(F.when((F.col("path")[1] == name) & (F.col("part") == part), v))
    number = F.coalesce("value.f", F.col("value.i").cast("double"))
    return rows.groupBy("s_suppkey").agg(pick("Bal", 0, number).alias("value"), pick("Label", 0, F.col("value.s")).alias("label"), pick("List", 1, F.col("value.i")).alias("second"))


@query("source_old_settings", "SELECT n_name AS section, 'Region' AS key, CAST(n_regionkey AS BIGINT) AS whole, CAST(NULL AS VARCHAR) AS text FROM (SELECT 'N' || n_nationkey AS n_name, n_regionkey FROM nation) UNION ALL SELECT 'N' || n_nationkey, 'Name', NULL, n_name FROM nation")
def source_old_settings(spark, d):
    rows = sorted(tuple(r) for r in R.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())  # 25 rows at every scale
    text = ":" + ";:".join(f'N{k}:REGION {r};NAME "{n}"' for k, n, r in rows)
    path = store.shared_folder(spark) + "/old.set"
    store.put(spark, path, text.encode())
    got = instruments.read_old_settings(spark, path)
    return got.select("section", "key", F.col("value.i").alias("whole"), F.col("value.s").alias("text"))


def _isf(info: dict[str, float], samples: list[int]) -> bytes:
    head = ":WFMP:" + ";".join(f"{k} {v}" for k, v in info.items())
    n = str(len(samples))
    return f"{head};:CURV #{len(n)}{n}".encode("latin-1") + bytes(v % 256 for v in samples)


def _nation_isf(k: int, r: int) -> bytes:
    return _isf({"XIN": 0.5, "XZE": r, "YOF": 2, "YMU": 0.25, "YZE": 10}, [(k * 7 + j * 13) % 200 - 100 for j in range(12)])


_WAVE = "w AS (SELECT n_nationkey AS k, n_regionkey AS r, unnest(range(12)) AS j FROM nation), v AS (SELECT k, r, j, j * 0.5::DOUBLE + r AS t, ((k * 7 + j * 13) % 200 - 100 - 2) * 0.25::DOUBLE + 10 AS x FROM w)"


@query("source_waveforms", f"WITH {_WAVE} SELECT CAST(k AS INTEGER) AS nation, CAST(j AS BIGINT) AS i, t, x FROM v")
def source_waveforms(spark, d):
    path = store.shared_folder(spark)
    for r in R.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        store.put(spark, f"{path}/n{r[0]}.isf", _nation_isf(*r))
    got = instruments.read_waveforms(spark, path)
    return got.select(F.regexp_extract("file", r"n(\d+)\.isf$", 1).cast("int").alias("nation"), "i", "t", "x")


@query("source_scope", f"WITH {_WAVE} SELECT CAST(k AS INTEGER) AS channel, CAST(j // 5 AS BIGINT) AS i, avg(t) AS t, avg(x) AS x FROM v WHERE k IN (1, 3) AND j < 10 GROUP BY k, j // 5")
def source_scope(spark, d):
    """A capture whose channel 2 is off, in means of five samples."""
    prefix = store.shared_folder(spark) + "/T0001"
    regions = {r[0]: r[1] for r in R.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()}
    store.put(spark, prefix + ".SET", b":SELECT:CH1 1\n:SELECT:CH2 0\n:SELECT:CH3 1\n:HEADER 1\n")
    for k in (1, 2, 3):
        store.put(spark, f"{prefix}CH{k}.ISF", _nation_isf(k, regions[k]))
    return instruments.read_scope(spark, prefix, 5)[0]


@query("source_scope_csv", "SELECT CAST(n_regionkey + 1 AS INTEGER) AS channel, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS i, n_nationkey * 0.5::DOUBLE AS t, n_regionkey + n_nationkey * 0.25::DOUBLE AS x FROM nation")
def source_scope_csv(spark, d):
    """A file for each region, its rows in falling order."""
    path, files = store.shared_folder(spark), {}
    for k, r in sorted((tuple(x) for x in R.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()), reverse=True):
        files.setdefault(r, []).append(f"Record {k},{r},,{k * 0.5},{r + k * 0.25}")
    for r, rows in files.items():
        store.put(spark, f"{path}/F0001CH{r + 1}.CSV", ("\r\n".join(rows) + "\r\n").encode())
    return instruments.read_scope_csv(spark, path).drop("file")


def _workbook(cells: dict[str, str | float]) -> bytes:
    one = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    body = "".join(f"<row>{one(at, v)}</row>" for at, v in cells.items())
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


@query("source_worksheet", "SELECT CAST(n_nationkey + 4 AS INTEGER) AS r, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def source_worksheet(spark, d):
    """The nations from cell C3 on, beside other cells; the table is found by its first heading."""
    cells = {"A1": "notes", "C3": "nation", "D3": "region", "F3": "apart", "C40": "below"}
    for k, n, r in (tuple(x) for x in R.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()):
        cells |= {f"C{k + 4}": n, f"D{k + 4}": float(r), f"F{k + 4}": "x"}
    path = store.shared_folder(spark) + "/w.xlsx"
    store.put(spark, path, _workbook(cells))
    got = instruments.read_cells(spark, path)
    at = instruments.find_cell(got, "nation").first()
    rows = instruments.table_at(got, at["r"], at["c"])
    return rows.groupBy("r").agg(F.max(F.when(F.col("name") == "nation", F.col("s"))).alias("name"), F.max(F.when(F.col("name") == "region", F.col("v"))).alias("region"))


@query("source_octave", "SELECT n_name AS path, 'scalar' AS type, CAST(n_regionkey AS DOUBLE) AS number FROM (SELECT 'n' || n_nationkey || '.region' AS n_name, n_regionkey FROM nation) UNION ALL SELECT 'keys', 'matrix', CAST(sum(n_nationkey) AS DOUBLE) FROM nation")
def source_octave(spark, d):
    rows = sorted(tuple(x) for x in R.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())
    text = "# Created\n" + "".join(f"# name: n{k}\n# type: scalar struct\n# ndims: 2\n 1 1\n# length: 1\n# name: region\n# type: scalar\n{r}\n\n\n\n\n" for k, r in rows)
    text += f"# name: keys\n# type: matrix\n# rows: 1\n# columns: {len(rows)}\n {' '.join(str(k) for k, _ in rows)}\n\n\n"
    path = store.shared_folder(spark) + "/t.mat"
    store.put(spark, path, text.encode())
    got = instruments.read_octave_text(spark, path)
    total = F.aggregate(F.from_json(F.to_json("value"), "array<double>"), F.lit(0.0), lambda a, b: a + b)
    return got.select("path", "type", F.when(F.col("type") == "matrix", total).otherwise(F.try_variant_get("value", "$", "double")).alias("number"))


@query("source_mat", "SELECT 'keys' AS path, 'double' AS type, CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM nation UNION ALL SELECT 'regions', 'int32', n_nationkey, n_regionkey, NULL FROM nation UNION ALL SELECT 'names{' || n_nationkey || '}', 'char', 0, NULL, n_name FROM nation UNION ALL SELECT 'first.name', 'char', 0, NULL, n_name FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'first.region', 'double', 0, n_regionkey, NULL FROM nation WHERE n_nationkey = 0")
def source_mat(spark, d):
    """A binary file with an array, whole numbers, a cell array of texts and a structure."""
    from ..sources import matfile

    rows = sorted(tuple(x) for x in R.table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name").collect())
    path = store.shared_folder(spark) + "/t.mat"
    matfile.write_mat(spark, path, {"keys": [float(k) for k, _, _ in rows], "regions": [r for _, r, _ in rows], "names": [[n] for _, _, n in rows], "first": {"name": rows[0][2], "region": float(rows[0][1])}})
    return matfile.read_mat(spark, path).drop("file")


@query("source_pictures", f"WITH {R.IMAGES} SELECT y, CAST(img % 16 * 8 + x AS INTEGER) AS x, CAST(0 AS INTEGER) AS channel, CAST(v * 255 AS INTEGER) AS v FROM im WHERE img < 16")
def source_pictures(spark, d):
    """The first sixteen pictures side by side, written as one picture file and read back."""
    from ..sources import pictures

    im = R.images(spark, d).where("img < 16")
    path = store.shared_folder(spark) + "/p.png"
    pictures.write_picture(im.select("y", (F.col("img") % 16 * 8 + F.col("x")).cast("int").alias("x"), (F.col("v") * 255).alias("v")), path)
    return pictures.read_pictures(spark, path).drop("file")


@query("source_bag", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def source_bag(spark, d):
    """Two tables saved together, loaded together."""
    path = store.shared_folder(spark)
    bags.save(path, nations=R.table(spark, d, "nation"), regions=R.table(spark, d, "region"))
    got = bags.load(spark, path)
    return got["nations"].join(got["regions"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("build_steps", "SELECT * FROM (VALUES (0, 'a', true), (0, 'b', true), (1, 'a', false), (1, 'b', false), (2, 'a', true), (2, 'b', true)) t(turn, target, ran)")
def build_steps(spark, d):
    """Two targets are built, then not again, then again as their source was written anew."""
    path, out = store.shared_folder(spark), []
    nation = R.table(spark, d, "nation")
    nation.write.parquet(f"{path}/in")
    targets = [(f"{path}/{t}", [f"{path}/in"]) for t in "ab"]
    for turn in range(3):
        if turn == 2:
            import time

            time.sleep(1.1)  # stores keep times to the second
            nation.write.mode("overwrite").parquet(f"{path}/in")
        out += [(turn, t, ran) for t, ran in zip("ab", bags.build_all(spark, targets, lambda df: df.groupBy("n_regionkey").count()), strict=True)]
    return spark.createDataFrame(out, "turn int, target string, ran boolean")


@query("table_summary", "SELECT * FROM (SELECT 'n_name' AS name, 'string' AS type, count(*) AS rows, count_if(n_name IS NULL) AS nulls, min(n_name) AS low, max(n_name) AS high FROM nation UNION ALL SELECT 'n_nationkey', 'int', count(*), count_if(n_nationkey IS NULL), CAST(min(n_nationkey) AS VARCHAR), CAST(max(n_nationkey) AS VARCHAR) FROM nation UNION ALL SELECT 'n_regionkey', 'int', count(*), count_if(n_regionkey IS NULL), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation)")
def table_summary(spark, d):
    return bags.summary(R.table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_regionkey").cast("int").alias("n_regionkey"))).drop("distinct")


@query(
    "streamed_events",
    """WITH s AS (SELECT user_id AS k, ts, value AS x, event_id FROM events), m AS (SELECT *, CASE WHEN x >= 300 THEN 1 WHEN x <= 150 THEN 0 END AS mk FROM s),
t AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM m),
u AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER w, 0) = 0 THEN 1 ELSE 0 END AS e, lead(ts) OVER w AS nx FROM t WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)), v AS (SELECT *, sum(e) OVER (PARTITION BY k ORDER BY ts, event_id) AS event FROM u)
SELECT k, epoch_us(min(ts)) AS up, epoch_us(arg_max(nx, (ts, event_id))) AS down, max(x) AS peak FROM v WHERE st = 1 GROUP BY k, event HAVING count(nx) = count(*)""",
)
def streamed_events(spark, d):
    """The users' signals in two files, one a trigger, through the streaming operator; events that end are its rows."""
    path = store.shared_folder(spark)
    e = R.table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("t"), F.col("value").alias("x"))
    middle = e.select(F.unix_micros("t").alias("m")).approxQuantile("m", [0.5], 0.01)[0]
    first = F.unix_micros("t") < F.lit(int(middle))
    for part in (first, ~first):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.TimestampType()), T.StructField("x", T.DoubleType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = schmitt_stream(stream, "k", "t", "x", 300.0, 150.0).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema("k long, up timestamp, down timestamp, peak double").parquet(f"{path}/out")
    return got.select("k", F.unix_micros("up").alias("up"), F.unix_micros("down").alias("down"), "peak")
