"""Sinks: versioned generations, exports of lines, delta pages, health, manifests, checkpoints."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.pages import greedy_pages, json_pages

SCHEMA_VERSION = "1.0"
# Changes that a delta exports.
EXPORTABLE = (
    "new", "materially-changed", "deadline-changed", "requirements-changed", "dates-changed", "location-changed", "application-opened", "application-closed", "reopened",
)


def tree_digest(rows: DataFrame, key: str, text: str, fanout: int = 1024) -> DataFrame:
    """One row, ``digest``: a hash tree over the lines in the order of a whole-number key, ``fanout`` keys to a node.

    Unique keys bound every node, so no task gathers the table.
    """
    level = rows.select(F.col(key).cast("long").alias("k"), F.col(text).alias("h"))
    for _ in range(4):
        node = F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "h"))).getField("h"), "\n"), 256)
        level = level.groupBy(F.expr(f"k div {fanout}").alias("p")).agg(node.alias("h")).select(F.col("p").alias("k"), "h")
    return level.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "h"))).getField("h"), "\n"), 256).alias("digest"))


class Store:
    """Versioned tables under one folder: ``name/gen=N/...`` and a pointer file for each generation, ``current-N.json``, written last.

    A reader takes the highest pointer, so it sees a generation wholly or not
    at all; a crash leaves the one before, and no pointer is ever replaced. Paths go through Hadoop's file systems, so any shared store works.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def put(self, path: str, text: str) -> None:
        """Write a small new file under another name and rename it into place; fails if the file is there."""
        fs, final = self._path(f"{self.root}/{path}")
        _, part = self._path(f"{self.root}/{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise FileExistsError(f"{path}: another writer was first")

    def get(self, path: str) -> str | None:
        fs, p = self._path(f"{self.root}/{path}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def generation(self, name: str) -> int:
        """The number of the newest whole generation, 0 for none."""
        fs, folder = self._path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return max((int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json")), default=0)

    def read(self, name: str) -> DataFrame | None:
        return self.tables(name).get("")

    def tables(self, name: str) -> dict[str, DataFrame]:
        """The tables of the newest generation by name."""
        return {t: self.spark.read.parquet(*(f"{self.root}/{name}/{f}" for f in folders)) for t, folders in self.note(name).get("tables", {}).items()}

    def write(self, name: str, df: DataFrame, **note) -> int:
        return self.commit(name, {"": df}, **note)

    def commit(self, name: str, tables: Mapping[str, DataFrame], added: Mapping[str, DataFrame] | None = None, **note) -> int:
        """Write all tables of the next generation, then the one pointer that names them.

        Of tables in ``added`` only new rows are written; the pointer names
        their folders beside those of the generation before. Folders are the
        writer's own, so of two writers of one generation the second fails at
        the pointer and harms nothing.
        """
        gen, own = self.generation(name) + 1, uuid.uuid4().hex[:12]
        had = self.note(name).get("tables", {})
        folders: dict[str, list[str]] = {}
        for t, df in {**tables, **(added or {})}.items():
            folder = f"gen={gen}/{own}" + (f"/{t}" if t else "")
            df.write.parquet(f"{self.root}/{name}/{folder}")
            folders[t] = [*(had.get(t, []) if t in (added or {}) else []), folder]
        self.put(f"{name}/current-{gen}.json", json.dumps({"gen": gen, "tables": folders, **note}, sort_keys=True))
        return gen

    def note(self, name: str) -> dict:
        """What the newest pointer says; empty for none."""
        return json.loads(self.get(f"{name}/current-{self.generation(name)}.json") or "{}")


def document(columns: Mapping[str, Column]) -> Column:
    """Canonical JSON of a row: keys in order, nulls kept."""
    return F.to_json(F.struct(*(columns[c].alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def write_lines(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in the order of ``key``; sorted by range, so no task sees all."""
    df.orderBy(key).select(document({c: F.col(c) for c in df.columns}).alias("value")).write.mode("overwrite").text(path)


def delta(entities: DataFrame, changes: DataFrame, mark: int, id_col: str = "entity_id") -> DataFrame:
    """Entities with an exportable change after the high-water mark."""
    fresh = changes.where((F.col("change_id") > mark) & F.col("change_type").isin(*EXPORTABLE)).select(id_col).distinct()
    return entities.join(fresh, id_col, "left_semi")


def delta_pages(rows: DataFrame, key: str, limit: int = 120_000, overhead: int = 512) -> DataFrame:
    """``rows`` of one run's delta with ``page``: as many as fit the byte limit, in order."""
    sized = rows.withColumn("__json", document({c: F.col(c) for c in rows.columns}))
    pages = greedy_pages(sized, key, F.octet_length("__json") + 1, limit, overhead)
    return rows.join(pages.select(key, "page"), key)


def delta_documents(rows: DataFrame, key: str, head: Mapping[str, object], limit: int = 120_000, room: int | None = None) -> DataFrame:
    """(page, file, document): the JSON pages of a delta, each within ``limit`` bytes; ``head`` begins every one, ``room`` as in ``json_pages``."""
    lines = rows.select(key, document({c: F.col(c) for c in rows.columns}).alias("__json"))
    return json_pages(lines, key, "__json", json.dumps(dict(head), sort_keys=True, separators=(",", ":"))[1:-1], limit, room=room)


def stale_pages(names: Sequence[str], pages: int) -> list[str]:
    """Names of delta pages beyond the last one."""
    found = []
    for name in names:
        number = name.removeprefix("delta_packet.p").removesuffix(".json")
        if name == f"delta_packet.p{number}.json" and number.isdigit() and int(number) >= 2 and int(number) > pages:
            found.append(name)
    return found


def source_health(sources: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each source with its newest check, number of sources by state); never-checked ones are ``not-checked``."""
    newest = checks.groupBy("source_id").agg(F.max_by(F.struct("checked_at", "state", "detail"), F.struct("checked_at", "check_id")).alias("c"))
    rows = sources.join(newest, "source_id", "left").select(sources["*"], "c.checked_at", F.coalesce("c.state", F.lit("not-checked")).alias("state"), "c.detail")
    return rows, rows.groupBy("state").agg(F.count(F.lit(1)).alias("sources"))


def manifest(files: Mapping[str, bytes], generated_at: str) -> dict:
    """Hashes and sizes of a generation's small files; its id is the hash of their canonical form."""
    entries = {n: {"sha256": hashlib.sha256(b).hexdigest(), "bytes": len(b)} for n, b in sorted(files.items())}
    canonical = json.dumps(entries, sort_keys=True, separators=(",", ":"))
    return {"schema_version": SCHEMA_VERSION, "generated_at": generated_at, "files": entries, "generation_id": hashlib.sha256(canonical.encode()).hexdigest()}


def verified_lines(spark: SparkSession, path: str, sha256: str, key: str) -> DataFrame:
    """JSON lines of one file whose hash must be as the manifest says, with unique keys."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    if found is None or found["h"] != sha256:
        raise ValueError(f"{path} is not what the manifest names")
    rows = spark.read.json(path)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d")).first()
    if n["n"] != n["d"]:
        raise ValueError(f"{path} has repeated keys")
    return rows


def render_packet(rows: Sequence[Mapping], limit: int = 120_000) -> str:
    """Markdown of the (at most forty) selected leads, cut before the first section that passes the byte limit."""
    escape = lambda s: "".join("\\" + c if c in "\\`*_[]<>|" else c for c in str(s or "").replace("\n", " "))
    parts, used = ["# Review packet\n"], len("# Review packet\n")
    for i, row in enumerate(rows, 1):
        section = f"\n## {i}. {escape(row.get('title'))}\n\n" + "".join(f"- {k}: {escape(row[k])}\n" for k in sorted(row) if k != "title" and row[k] is not None)
        size = len(section.encode())
        if used + size > limit:
            parts.append(f"\n{len(rows) - i + 1} more leads did not fit.\n")
            break
        parts.append(section)
        used += size
    return "".join(parts)
