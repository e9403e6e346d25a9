"""Workspace tools and roots, and the module a path belongs to."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodegraph.functions.paths import default_module

# The root files that tell the tool.
ROOT_FILES = "pnpm-workspace.yaml pnpm-workspace.yml package.json turbo.json nx.json go.work Cargo.toml cargo.toml lerna.json".split()


def _glob(g: str) -> str:
    return g.removeprefix("/").rstrip("/")


def _globs(raw) -> list[str]:
    if isinstance(raw, str):
        return [_glob(raw)]
    return [_glob(str(g)) for g in raw] if isinstance(raw, list) else []


def _json(text: str | None) -> dict:
    try:
        got = json.loads(text or "")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def detect(files: dict[str, str | None]) -> tuple[str, list[str]]:
    """Tool and root globs from the files at a repository's root: the first tool in a fixed order wins."""
    rows = lambda text: re.split(r"\r?\n", text or "")
    for p in ROOT_FILES[:2]:
        if p in files:
            return "pnpm", [_glob(m[1]) for r in rows(files[p]) if (m := re.match(r"^\s*-\s+[\"']?([^\"'\s#]+)[\"']?\s*(?:#.*)?$", r))]
    if globs := _globs(_json(files.get("package.json")).get("workspaces") or None):
        return "turbo" if "turbo.json" in files else "nx" if "nx.json" in files else "npm", globs
    if "turbo.json" in files:
        ws = _json(files["turbo.json"]).get("workspace")
        return "turbo", _globs(ws) if isinstance(ws, list) else []
    if "nx.json" in files:
        return "nx", []
    if "go.work" in files:
        uses = [m[1] for r in rows(files["go.work"]) if (m := re.match(r"^\s*use\s+(\S+)", r))]
        return "go-work", [g for u in uses if (g := _glob(re.sub(r'^"|"$', "", u)))]
    if cargo := next((p for p in ROOT_FILES[6:8] if p in files), None):
        inside, roots = False, []
        for r in rows(files[cargo]):
            if m := re.match(r"^\s*\[(.+)\]\s*$", r):
                inside = m[1] == "workspace"
            elif inside and (m := re.match(r"^\s*members\s*=\s*(.+)$", r)):
                roots += [_glob(x) for x in re.findall(r'"([^"]+)"', m[1])]
        if inside or roots:
            return "cargo-workspace", roots
    if "lerna.json" in files:
        return "lerna", _globs(_json(files["lerna.json"]).get("packages"))
    return "none", []


def monorepo_detect(files: DataFrame) -> DataFrame:
    """(repo_id, tool, globs): a group holds at most the nine root files of a repository."""
    kind = files.schema["repo_id"].dataType.simpleString()
    roots = files.where(F.col("path").isin(*ROOT_FILES)).groupBy("repo_id", "path").agg(F.max("content").alias("content"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tool, globs = detect({p: None if c is None or c != c else c for p, c in zip(pdf["path"], pdf["content"])})
        return pd.DataFrame({"repo_id": [pdf["repo_id"].iloc[0]], "tool": [tool], "globs": [globs]})

    found = roots.groupBy("repo_id").applyInPandas(one, f"repo_id {kind}, tool string, globs array<string>")
    every = files.where("repo_id is not null").select("repo_id").distinct()
    return every.join(found, "repo_id", "left").select("repo_id", F.coalesce("tool", F.lit("none")).alias("tool"), F.coalesce("globs", F.array().cast("array<string>")).alias("globs"))


def workspace_roots(globs: DataFrame, files: DataFrame, recursive: bool = False) -> DataFrame:
    """(repo_id, root): `dir/*` becomes the first segments found below dir, files too; other globs, and those without a hit, stay.

    recursive treats `dir/**` as `dir/*`; otherwise such a glob stays as it is and matches nothing.
    """
    g = globs.select("repo_id", F.explode("globs").alias("glob")).distinct()
    star = r"^(.+?)/\*\*?$" if recursive else r"^(.+?)/\*$"
    g = g.withColumn("dir", F.when(F.col("glob").rlike(star), F.regexp_extract("glob", star, 1)))
    # every directory above a path, with the segment below it: an equi-join instead of a comparison of prefixes
    parts = F.split("path", "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), F.get(parts, i).alias("first")))
    paths = files.where("path is not null and instr(path, '/') > 0").select("repo_id", F.explode(below).alias("b")).select("repo_id", "b.dir", "b.first").where("first <> ''").distinct()
    hits = g.where("dir is not null").join(paths, ["repo_id", "dir"]).select("repo_id", "glob", F.concat_ws("/", "dir", "first").alias("root"))
    out = g.join(hits, ["repo_id", "glob"], "left").select("repo_id", F.coalesce("root", "glob").alias("root"))
    return out.distinct()


def ranked_roots(roots: DataFrame) -> DataFrame:
    """(repo_id, root, rank): the longest root first, then by name."""
    return roots.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc(F.length("root")), "root")))


def assign_modules(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, path, module): the longest root that is the path or a directory above it, else the default module."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = files.where("path is not null").select("repo_id", "path").distinct()
    above = own.select("repo_id", "path", F.explode(prefixes).alias("root")).join(roots.select("repo_id", "root").distinct(), ["repo_id", "root"])
    best = above.groupBy("repo_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return own.join(best, ["repo_id", "path"], "left").select("repo_id", "path", F.coalesce("root", default_module(F.col("path"))).alias("module"))
