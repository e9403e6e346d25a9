"""Sources of files: directories, uploads, repository trees, pages, and a synthetic graph. All give (path, content, size)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.functions import dictionaries as D
from lodegraph.functions.paths import depth, is_config, is_source

SCHEMA = "path string, content string, size bigint"


def classify_target(url: Column) -> Column:
    """struct(owner, repo, target_type) of a target, null where it is none of directory, repository or page."""
    t = F.trim(url)
    parts = lambda x: F.element_at(F.split(x, "/"), -1)
    name = lambda x: F.coalesce(F.nullif(parts(x), F.lit("")), F.lit("local-project"))
    made = lambda o, r, k: F.struct(o.alias("owner"), r.alias("repo"), F.lit(k).alias("target_type"))
    local = t.rlike(r"^[a-zA-Z]:[\\/]") | t.startswith("/")
    scheme = F.lower(F.regexp_extract(t, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(t, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(t, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    owner, repo = F.split(F.regexp_replace(path, "^/", ""), "/")[0], F.get(F.split(F.regexp_replace(path, "^/", ""), "/"), F.lit(1))
    hub = F.when((F.length(owner) > 0) & (F.length(repo) > 0), made(owner, F.regexp_replace(repo, r"\.git$", ""), "github"))
    slashed = F.regexp_replace(t, r"\\", "/")
    return (
        F.when(local, made(F.lit("local"), name(slashed), "local"))
        .when(scheme == "file", made(F.lit("local"), name(path), "local"))
        .when((host != "") & host.rlike(r"github\.com$"), hub)
        .when(scheme.isin("http", "https") & (host != ""), made(F.lit("web"), host, "website"))
    )


def repo_of_url(url: Column) -> Column:
    """struct(owner, repo): the last two segments without a trailing .git."""
    parts = F.split(F.regexp_replace(url, r"\.git$", ""), "/")
    at = lambda i, d: F.coalesce(F.nullif(F.try_element_at(parts, F.lit(i)), F.lit("")), F.lit(d))
    return F.struct(at(-2, "unknown-owner").alias("owner"), at(-1, "unknown-repo").alias("repo"))


def scannable(path: Column) -> Column:
    return is_source(path) | is_config(path)


def cap_tree(files: DataFrame, max_files: int = D.MAX_FILES, max_bytes: int = D.MAX_BYTES, order: str = "ord", key: str = "repo_id") -> DataFrame:
    """The sources and configurations of a tree up to a size, shallow ones first, then in order; at most max_files for each repository.

    The cap is the feature. Ranks are taken within slices of a repository first, so that no task sees more than the survivors of all slices.
    """
    own = files.where(scannable(F.col("path")) & (F.coalesce("size", F.lit(0)) <= max_bytes)).withColumn("depth", depth(F.col("path")))
    own = own.withColumn("_s", F.pmod(F.xxhash64("path"), F.lit(64)))
    own = own.withColumn("_r", F.row_number().over(W.partitionBy(key, "_s").orderBy("depth", order))).where(F.col("_r") <= max_files)
    own = own.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("depth", order))).where(F.col("_r") <= max_files)
    return own.drop("_s", "_r")


def local_filter(files: DataFrame) -> DataFrame:
    """Without paths below skipped directories, sources and configurations only."""
    segments = F.split("path", "/")
    return files.where(~F.arrays_overlap(segments, F.array(*map(F.lit, D.LOCAL_SKIPPED))) & scannable(F.col("path")))


def upload_filter(files: DataFrame) -> DataFrame:
    """What a folder picker sends: without skipped directories inside the path and without binary extensions."""
    from lodegraph.functions.paths import extension

    keep = ~extension(F.col("path")).isin(*D.UPLOAD_SKIPPED_EXTENSIONS)
    for d in D.UPLOAD_SKIPPED_DIRS:
        keep = keep & ~F.col("path").contains(d)
    return files.where(keep)


def read_directory(spark: SparkSession, root: str, max_files: int = D.MAX_FILES, max_bytes: int = D.MAX_BYTES) -> DataFrame:
    """(path, content, size) of a directory tree; paths are relative. The cap comes before the size filter."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    own = raw.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), "length", "content")
    own = local_filter(own).orderBy("path").limit(max_files).where(F.col("length") <= max_bytes)
    return own.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def read_file(files: DataFrame) -> DataFrame:
    """files with lines (ends at LF only) and size_bytes of the content; null where there is no content."""
    return files.withColumn("lines", F.size(F.split("content", "\n", -1))).withColumn("size_bytes", F.octet_length("content")).withColumn("lines", F.when(F.col("content").isNotNull(), F.col("lines")))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Uploaded files as they are: no filter, no cap."""
    return spark.createDataFrame([(r["path"], r.get("content"), r.get("size")) for r in rows], SCHEMA)


def from_tree(spark: SparkSession, tree_json: str) -> tuple[DataFrame, bool]:
    """(path, size, ord) of the blobs of a repository's recursive tree listing, and whether it was truncated."""
    import json

    got = json.loads(tree_json)
    rows = [(x["path"], x.get("size"), i) for i, x in enumerate(got.get("tree", [])) if x.get("type") == "blob"]
    return spark.createDataFrame(rows, "path string, size bigint, ord bigint"), bool(got.get("truncated"))


_TREE = "tree array<struct<path:string,type:string,size:bigint>>, truncated boolean"


def from_trees(pages: DataFrame, key: str = "repo_id") -> tuple[DataFrame, DataFrame]:
    """(key, path, size, ord) of the blobs in the pages (key, page, tree_json) of tree listings, and (key, truncated).

    A page that is no listing has no blobs and counts as truncated.
    """
    own = pages.select(key, "page", F.from_json("tree_json", _TREE).alias("t"))
    blobs = own.select(key, "page", F.posexplode("t.tree").alias("at", "b")).where("b.type = 'blob' and b.path is not null")
    cut_ = own.groupBy(key).agg(F.max(F.coalesce("t.truncated", F.col("t.tree").isNull())).alias("truncated"))
    return blobs.select(key, "b.path", "b.size", (F.col("page") * 1_000_000 + F.col("at")).alias("ord")), cut_


def fetch_contents(rows: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """rows with content and error: what fetch gives for each path; a failure keeps the row without content and says why.

    Each partition fetches its own rows one by one, so as many fetches run at once as there are tasks.
    """

    @F.pandas_udf("content string, error string")
    def run(paths: pd.Series) -> pd.DataFrame:
        out = []
        for p in paths:
            try:
                out.append((None, "no path") if p is None else (fetch(p), None))
            except Exception as e:  # the reason is kept, the row too
                out.append((None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(out, columns=["content", "error"])

    return rows.drop("content", "error").withColumn("_r", run(F.col("path"))).select(*[c for c in rows.columns if c not in ("content", "error")], "_r.content", "_r.error")


def scan_report(rows: DataFrame, listed: DataFrame, truncated: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, warnings, limitations, quality): what a scan couldn't read and what it left out.

    rows is (key, path, ord, error) of what was fetched, listed (key, files) how many could have been, truncated (key, truncated).
    Quality is `partial` where the listing was truncated or capped, else `full`; keys are those of listed.
    """
    from lodegraph.operators.reports import warning_rollup

    bad = rows.where("error is not null").select(key, "ord", F.concat("path", F.lit(": "), "error").alias("text"))
    own = listed.join(rows.groupBy(key).agg(F.count("*").alias("kept")), key, "left").join(truncated, key, "left").join(warning_rollup(bad, key), key, "left")
    cut_ = F.coalesce("truncated", F.lit(False))
    capped = F.coalesce("kept", F.lit(0)) < F.col("files")
    notes = F.array_compact(F.array(F.when(cut_, "The tree was truncated."), F.when(capped, F.concat(F.lit("Only "), F.coalesce("kept", F.lit(0)).cast("string"), F.lit(" of "), F.col("files").cast("string"), F.lit(" files were read.")))))
    return own.select(key, F.coalesce("warnings", F.lit("")).alias("warnings"), F.array_join(notes, "\n").alias("limitations"), F.when(cut_ | capped, "partial").otherwise("full").alias("quality"))


def page_assets(pages: DataFrame) -> DataFrame:
    """(url, asset): scripts, styles and sources that pages (url, html) refer to, made absolute; each once."""
    from lodegraph.operators.imports import extract_imports

    as_files = pages.select(F.col("url").alias("repo_id"), F.lit("index.html").alias("path"), F.col("html").alias("content"))
    refs = extract_imports(as_files).select(F.col("repo_id").alias("url"), "raw")
    ends = F.lit(False)
    for e in D.ASSET_ENDINGS:
        ends = ends | F.col("raw").endswith(e)
    origin = F.regexp_extract("url", r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    scheme = F.regexp_extract("url", r"^([a-zA-Z][\w+.-]*:)", 1)
    raw = F.col("raw")
    whole = F.when(raw.rlike(r"^[a-zA-Z][\w+.-]*:"), raw).when(raw.startswith("//"), F.concat(scheme, raw)).when(raw.startswith("/"), F.concat(origin, raw)).otherwise(F.concat(folder, F.lit("/"), raw))
    return refs.where(ends).select("url", whole.alias("asset")).distinct()


def asset_path(asset: Column) -> Column:
    """The path of an asset in the collection: its URL's path without the leading slash, `unknown` without one."""
    p = F.regexp_replace(F.regexp_extract(asset, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), "^/", "")
    return F.coalesce(F.nullif(p, F.lit("")), F.lit("unknown"))


class Registry:
    """Sources in order; the first that can serve a target and doesn't fail wins. What was tried is kept."""

    def __init__(self):
        self.sources: list[tuple[str, Callable[[str], bool], Callable[[SparkSession, str], DataFrame]]] = []

    def add(self, name: str, can: Callable[[str], bool], read: Callable[[SparkSession, str], DataFrame]) -> None:
        self.sources.append((name, can, read))

    def read(self, spark: SparkSession, target: str) -> tuple[DataFrame, list[dict]]:
        tried: list[dict] = []
        for name, can, read in self.sources:
            if not can(target):
                tried.append({"source": name, "status": "skipped"})
                continue
            try:
                df = read(spark, target)
            except Exception as e:  # the reason is kept, and the next source has its turn
                tried.append({"source": name, "status": "failed", "reason": str(e)[:200]})
                continue
            return df, [*tried, {"source": name, "status": "used"}]
        raise RuntimeError(f"no source could read {target}: {tried}")
