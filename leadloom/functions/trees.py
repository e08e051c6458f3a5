"""Trees of JSON: recursive merge, removal of paths, and the kinds of their values."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def merged(left, right):
    """Objects merge key by key, at any depth; of anything else the right one counts, lists as a whole."""
    if not (isinstance(left, dict) and isinstance(right, dict)):
        return right
    return left | {k: merged(left[k], v) if k in left else v for k, v in right.items()}


def removed(tree, path: list[str]):
    """The tree without what lies at a path of keys; a path that isn't there changes nothing."""
    if not path or not isinstance(tree, dict) or path[0] not in tree:
        return tree
    if len(path) == 1:
        return {k: v for k, v in tree.items() if k != path[0]}
    return tree | {path[0]: removed(tree[path[0]], path[1:])}


def _loads(text: str | None):
    try:
        return None if text is None else (json.loads(text),)
    except ValueError:
        return None


def _dumps(tree) -> str:
    return json.dumps(tree, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.arrow_udf(StringType())
def deep_merge(left: pa.Array, right: pa.Array) -> pa.Array:
    """JSON of the merged trees, keys in order. A side that is null or no JSON leaves the other; both: null."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
        x, y = _loads(a), _loads(b)
        both = merged(x[0], y[0]) if x and y else (x or y or (None,))[0]
        out.append(_dumps(both) if x or y else None)
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def _remove(tree: pa.Array, path: pa.Array) -> pa.Array:
    out = []
    for t, p in zip(tree.to_pylist(), path.to_pylist(), strict=True):
        x = _loads(t)
        out.append(_dumps(removed(x[0], p or [])) if x else None)
    return pa.array(out, pa.string())


def json_remove(tree: Column, *path: str) -> Column:
    """JSON without what lies at a path of keys, keys in order; null for null or no JSON."""
    return _remove(tree, F.array(*(F.lit(p) for p in path)))


def json_type(tree: Column, *path: str) -> Column:
    """object, array, string, number, boolean or null of what lies at a path of keys; null where nothing does."""
    at = "$" + "".join(f"['{p}']" for p in path)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(tree), at, "variant"))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )
