"""Conformance matrices, expectations and anchors as joins over tables.

Tables, by their columns:

* issues: phase, row, column (or ``*``), upstream, evidence, wontfix, vendor_kind,
  vendor_path, vendor_expected, expect_kind (any, contains), expect_text
* axes: phase, row, column: the cells that a matrix has
* cells: phase, row, column, kind (blank, skip, ok, lossy, error, break), text
* expectations: fixture, impl, verdict; outcomes: fixture, impl, kill_reason, stderr,
  signal, code, spawn_error
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
_CELL = ("phase", "row", "column")


# ---- known issues --------------------------------------------------------------------


def issue_errors(issues: DataFrame, axes: DataFrame) -> DataFrame:
    """(phase, row, column, error): what is wrong with the catalogue, a row for each."""
    blank = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) == ""
    rows = axes.select("phase", "row").distinct().withColumn("row_known", F.lit(True))
    columns = axes.select("phase", "column").distinct().withColumn("column_known", F.lit(True))
    known = issues.join(rows, ["phase", "row"], "left").join(columns, ["phase", "column"], "left")
    rules = [
        (blank("upstream"), "no upstream"),
        (blank("evidence"), "no evidence"),
        (c("row") == "*", "a wildcard for rows"),
        (c("evidence").contains("vendor/") & c("vendor_path").isNull(), "evidence in vendor/ without a pin"),
        (F.coalesce(c("wontfix"), F.lit(False)) & ~c("evidence").rlike("https?://"), "won't be fixed, without an address that says so"),
        (c("row_known").isNull() & (c("row") != "*"), "unknown row"),
        (c("column_known").isNull() & (c("column") != "*"), "unknown column"),
    ]
    said = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in rules]), lambda x: x.isNotNull())
    return known.select(*_CELL, F.explode(said).alias("error"))


def expanded_issues(issues: DataFrame, axes: DataFrame) -> DataFrame:
    """Issues by cell: ``*`` stands for all columns of the phase; an issue that names the
    column comes before one with a wildcard."""
    columns = axes.select("phase", c("column").alias("real")).distinct()
    exact = issues.where("column <> '*'").withColumn("wild", F.lit(False))
    wild = issues.where("column = '*'").join(columns, "phase").withColumn("column", c("real")).drop("real").withColumn("wild", F.lit(True))
    both = exact.unionByName(wild)
    rest = [x for x in both.columns if x not in (*_CELL, "wild")]
    best = both.groupBy(*_CELL).agg(F.min_by(F.struct(*rest), F.struct("wild", "upstream")).alias("i"))
    return best.select(*_CELL, "i.*")


def classify(cells: DataFrame, issues: DataFrame, axes: DataFrame) -> DataFrame:
    """(phase, row, column, token, text): OK, OK* (a known issue is gone), KI, WTF, ERR!
    (another error than the known one), ERR, BRKN, SKIP or nothing."""
    known = expanded_issues(issues, axes).select(*_CELL, F.struct("wontfix", "expect_kind", "expect_text").alias("i"))
    j = cells.join(known, list(_CELL), "left")
    same = (F.coalesce(c("i.expect_kind"), F.lit("any")) == "any") | c("text").contains(c("i.expect_text"))
    failed = F.when(c("i").isNull(), F.when(c("kind") == "error", "ERR").otherwise("BRKN")).when(~F.coalesce(same, F.lit(False)), "ERR!").when(c("i.wontfix"), "WTF").otherwise("KI")
    token = F.when(c("kind") == "blank", "").when(c("kind") == "skip", "SKIP").when(c("kind").isin("ok", "lossy"), F.when(c("i").isNull(), "OK").otherwise("OK*")).otherwise(failed)
    return j.select(*_CELL, token.alias("token"), "text")


TOKENS = {"ok": "OK", "known_issue": "KI", "wontfix": "WTF", "err": "ERR", "brkn": "BRKN", "skipped": "SKIP", "blank": "", "resolved": "OK*", "drifted": "ERR!"}


def matrix_stats(classified: DataFrame) -> DataFrame:
    """Tokens by phase, and whether a strict run fails: at an error, a resolved issue or
    a drifted one."""
    counts = [F.count(F.when(c("token") == t, 1)).alias(n) for n, t in TOKENS.items()]
    stats = classified.groupBy("phase").agg(*counts)
    return stats.withColumn("strict_failed", (c("err") > 0) | (c("resolved") > 0) | (c("drifted") > 0))


def encode_verdict(errors: Column, decoded: Column, same_size: Column, diff: Column, total: Column, ceiling: Column) -> Column:
    """fail, ok or lossy of an encoder's cell: validator errors, pages that don't decode
    or have another size fail; differing pixels fail beyond the ceiling, and where there
    is none."""
    share = F.when(total == 0, 1.0).otherwise(diff / total)
    return F.when((errors > 0) | ~decoded | ~same_size, "fail").when(diff == 0, "ok").when(ceiling.isNull() | (share > ceiling), "fail").otherwise("lossy")


# ---- anchors -------------------------------------------------------------------------


def anchors(issues: DataFrame) -> DataFrame:
    """(kind, path, expected, conflict): pins of third-party trees, once each; several
    expected values of one are a conflict."""
    pins = issues.where("vendor_path is not null").groupBy(c("vendor_kind").alias("kind"), c("vendor_path").alias("path"))
    return pins.agg(F.array_sort(F.collect_set("vendor_expected")).alias("e")).select("kind", "path", c("e")[0].alias("expected"), (F.size("e") > 1).alias("conflict"))


def anchor_of(binaries: DataFrame, pins: DataFrame) -> DataFrame:
    """(binary, path, expected): the git pin whose folder holds the binary, the first by
    path; null where there is none. Every ancestor of a binary is looked up, so this is
    an equality join."""
    parts = F.split("binary", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    git = pins.where("kind = 'git'").select("path", "expected")
    met = binaries.select("binary", F.explode(up).alias("path")).join(git, "path").groupBy("binary").agg(F.min(F.struct("path", "expected")).alias("a"))
    return binaries.select("binary").distinct().join(met, "binary", "left").select("binary", "a.path", "a.expected")


def drift(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """(relative, path, recorded, now): seeds whose recorded SHA-256 isn't the file's."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    return recorded.join(now, "path").where(F.lower("sha256") != c("now")).select("relative", "path", F.lower("sha256").alias("recorded"), "now")


# ---- decoders ------------------------------------------------------------------------

_SANITIZERS = {"ASAN": "AddressSanitizer:", "UBSAN": "UndefinedBehaviorSanitizer:", "LSAN": "LeakSanitizer:", "TSAN": "ThreadSanitizer:", "MSAN": "MemorySanitizer:"}


def outcome_token(outcomes: DataFrame) -> DataFrame:
    """Adds ``token`` (TIMEOUT, OOM, OUTCAP, SAN(..), SIG=n, EXIT n, OK), the
    ``classification`` and the ``verdict``."""
    text = F.coalesce(c("stderr"), F.lit(""))
    sanitizer = F.coalesce(*[F.when(text.contains(needle), name) for name, needle in _SANITIZERS.items()])
    killed = F.when(c("kill_reason") == "timeout", "TIMEOUT").when(c("kill_reason") == "memory", "OOM").when(c("kill_reason") == "output", "OUTCAP")
    token = F.coalesce(
        F.when(c("spawn_error").isNotNull(), "SPAWN"),
        killed,
        F.when(sanitizer.isNotNull(), F.concat(F.lit("SAN("), sanitizer, F.lit(")"))),
        F.when(c("signal").isNotNull(), F.concat(F.lit("SIG="), c("signal").cast("string"))),
        F.when(c("code") == 0, "OK"),
        F.concat(F.lit("EXIT "), F.coalesce(c("code").cast("string"), F.lit("?"))),
    )
    t = c("token")
    classification = F.when(t.isin("OK", "SPAWN", "TIMEOUT"), t).when(t.startswith("SAN") | (t == "OOM"), "SAN").when(t.startswith("SIG"), "CRASH").otherwise("EXIT")
    k = c("classification")
    verdict = F.when(k == "OK", "Ok").when(k == "EXIT", "RejectErr").when(k.isin("SAN", "CRASH"), "Crash").when(k == "TIMEOUT", "Timeout").otherwise("Unknown")
    return outcomes.withColumn("token", token).withColumn("classification", classification).withColumn("verdict", verdict)


def expectation_mismatches(expectations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(fixture, impl, expected, observed): expectations that are set, of the
    implementations that ran at all, and not met. What didn't run is Unknown."""
    seen = outcome_token(outcomes).select("fixture", "impl", c("verdict").alias("observed"))
    ran = outcomes.select("impl").distinct()
    asked = expectations.where("verdict <> 'Unknown'").join(ran, "impl", "left_semi")
    j = asked.join(seen, ["fixture", "impl"], "left").select("fixture", "impl", c("verdict").alias("expected"), F.coalesce("observed", F.lit("Unknown")).alias("observed"))
    return j.where(c("expected") != c("observed"))


# ---- fixtures and images -------------------------------------------------------------


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """(relative, shape, primary_check_id, check_ids, expectations, stream) of the folders
    below ``root`` that have an ``expected.toml``, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    folder = found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")

    @F.udf("struct<shape:string,primary_check_id:string,check_ids:array<string>,expectations:array<struct<impl:string,verdict:string>>>")
    def parsed(data):  # one small file per fixture
        t = tomllib.loads(bytes(data).decode())
        return t.get("shape"), t.get("primary_check_id"), t.get("check_ids", []), sorted((k, v.get("verdict")) for k, v in t.get("decoder", {}).items())

    toml = folder.where("file = 'expected.toml'").select("folder", parsed("content").alias("t"))
    streams = folder.where("file = 'stream.jb2'").select("folder", c("content").alias("stream"))
    base = F.lit(root.rstrip("/"))
    relative = F.regexp_replace("folder", "^file:(//)?", "")
    return toml.join(streams, "folder", "left").select(F.replace(relative, F.concat(base, F.lit("/"))).alias("relative"), "t.*", "stream").orderBy("relative")


def write_expected(primary_check_id: str, check_ids: list[str], shape: str = "validator-fixture") -> str:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return f"shape = {quote(shape)}\nprimary_check_id = {quote(primary_check_id)}\ncheck_ids = [{', '.join(map(quote, check_ids))}]\n"
