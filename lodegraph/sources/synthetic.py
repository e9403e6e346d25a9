"""A synthetic graph that depends on nothing but owner, repository and branch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Names of the synthetic graph, the constants of its generator and the draws spent before its structure.
MODULES = ["core", "api", "auth", "ui", "utils", "graph", "hooks"]
FILES = ["index", "types", "client", "server", "helpers", "config", "provider"]
EXTERNALS = ["react", "d3", "zod", "clsx"]
OFFSET, PRIME, STEP, SPENT = 2166136261, 16777619, 0x6D2B79F5, 3
_M = 0xFFFFFFFF


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = OFFSET
    data = text.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * PRIME) & _M
    return h


def uniform(seed: int) -> Callable[[], float]:
    """A 32-bit multiply-and-shift generator of numbers in [0, 1)."""
    a = seed & _M

    def draw() -> float:
        nonlocal a
        a = (a + STEP) & _M
        t = ((a ^ a >> 15) * (a | 1)) & _M
        t ^= (t + ((t ^ t >> 7) * (t | 61) & _M)) & _M
        return ((t ^ t >> 14) & _M) / 2**32

    return draw


def synthetic_graph(spark: SparkSession, owner: str, repo: str, branch: str = "main") -> tuple[DataFrame, DataFrame]:
    """nodes (id, label, kind, path, grp, loc, complexity) and edges (src, dst, weight, kind, ord)."""
    draw = uniform(fnv1a(f"{owner}/{repo}@{branch}"))
    pick = lambda n: int(draw() * n)
    for _ in range(SPENT):
        draw()
    nodes, edges, files = [], [], []
    mods = [(f"mod:{MODULES[i % len(MODULES)]}-{i}", MODULES[i % len(MODULES)]) for i in range(4 + pick(4))]
    nodes += [(i, name, "module", None, name, None, None) for i, name in mods]
    for mid, name in mods:
        for k in range(3 + pick(4)):
            stem = FILES[pick(len(FILES))] + (f"-{k}" if k else "")
            path = f"src/{name}/{stem}.ts"
            loc = 30 + pick(300)
            nodes.append((f"file:{path}", f"{stem}.ts", "file", path, name, loc, 1 + pick(15)))
            files.append(f"file:{path}")
            edges.append((mid, f"file:{path}"))
    for name in EXTERNALS:
        nodes.append((f"ext:{name}", name, "external", None, "external", None, None))
        edges += [(files[pick(len(files))], f"ext:{name}") for _ in range(1 + pick(3))]
    n = spark.createDataFrame(nodes, "id string, label string, kind string, path string, grp string, loc int, complexity int")
    e = spark.createDataFrame([(a, b, 1, "import", i) for i, (a, b) in enumerate(edges)], "src string, dst string, weight int, kind string, ord bigint")
    return n, e
