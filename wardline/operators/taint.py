"""Untrusted data from sources to sinks, over edge tables.

Tables, all keyed by ``file_id``:

* ``accesses``  file_id, node, expr, line          expressions read into a variable
* ``aliases``   file_id, alias                     handler parameters that are the request
* ``edges``     file_id, src, dst, sanitizer       assignments; sanitizer = called function
* ``calls``     file_id, call_id, line, object, method, n_args, arg0_kind, arg0_text, arg1_kind
* ``args``      file_id, call_id, arg_index, node  variables used in an argument
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import severity as sev
from ..functions import text
from ..functions.literal import literal_table, lookup
from ..session import cut_lineage, scratch_scope
from . import knowledge
from .taint_tables import (
    LAST_ARGUMENT,
    RIGHT_SIDE,
    SAME_SINKS,
    SANITIZERS,
    SINK_DESCRIPTIONS,
    SINKS,
    SOURCE_ALIASES,
    SOURCES,
    SQL_METHODS,
)

def match_sources(accesses: DataFrame, aliases: DataFrame) -> DataFrame:
    """Expressions that read untrusted input.

    All source names have two parts, so an exact or dotted-prefix match is an
    equality on the first two parts. A request alias counts when what follows it
    names a source exactly.
    """
    base = {**{k: k for k in SOURCES}, **SOURCE_ALIASES}
    table = literal_table(
        accesses.sparkSession,
        [{"source_type": k, "category": SOURCES[v][0], "severity_base": SOURCES[v][1]} for k, v in base.items()],
        "source_type string, category string, severity_base string",
    )
    two_parts = F.substring_index("expr", ".", 2)
    head = F.substring_index("expr", ".", 1)
    renamed = F.concat(F.lit("req."), F.expr("substring(expr, length(_head) + 2)"))
    rows = accesses.select("file_id", *[c for c in accesses.columns if c != "file_id"])
    plain = rows.where(two_parts.isin(list(base))).withColumn("source_type", two_parts)
    # only what would name a source behind an alias needs to know the file's aliases
    other = rows.where(~two_parts.isin(list(base))).withColumn("_head", head).withColumn("source_type", renamed)
    other = other.where(F.col("source_type").isin([k for k in SOURCES if k.startswith("req.")]))
    marks = aliases.select("file_id", F.col("alias").alias("_head"))
    through = other.join(marks, ["file_id", "_head"], "left_semi").select(plain.columns)
    return plain.unionByName(through).join(table, "source_type")


def source_labels(matched: DataFrame) -> DataFrame:
    """First label of every variable that is assigned from a source: the first source line, then the smallest path."""
    path = F.array_distinct(F.array("expr", "node"))
    order = F.struct(F.col("line").alias("source_line"), F.array_join(path, " ").alias("text"), "source_type", "expr", "category")
    first = matched.groupBy("file_id", "node").agg(F.min(order).alias("_label")).select("file_id", "node", "_label.*")
    empty = F.array().cast("array<struct<name:string,strength:string>>")
    return first.select("file_id", "node", "source_type", "source_line", "category", path.alias("path"), empty.alias("sanitizers"))


@dataclass(frozen=True)
class Reach:
    """What untrusted data reaches, without the paths; searched when it is first read.

    ``labels`` has a row for each tainted variable: its source's label and path, and a
    ``trace`` of steps (first, node, sanitizer, inner): from the variable before along an
    unbranched chain that begins with ``first`` over ``inner`` variables to ``node``.
    ``chains`` has the variables of those chains by ``first`` and ``hops``; it is None when
    no step of any trace skips variables. ``taint_findings`` searches on its own, together
    with the calls, so what it doesn't need of the labels is never moved.
    """

    edges: DataFrame
    starts: DataFrame
    max_hops: int | None = None

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame | None]:
        return _searched(self.edges, self.starts, self.max_hops)

    @property
    def labels(self) -> DataFrame:
        return self._found[0]

    @property
    def chains(self) -> DataFrame | None:
        return self._found[1]


STEP = "struct<first:string,node:string,sanitizer:string,inner:int>"
ROOT = ["source_type", "source_line", "category", "path", "sanitizers"]
#: What a shortest path's label is chosen by among paths of equal length; ``key`` is the path as text.
ORDER = ["hops", "source_line", "key", "source_type"]
#: A file of at most so many labels and edges is searched by one task; larger ones take the passes over all files.
SMALL_FILE = 500
#: The same with the calls of sinks and the arguments of calls, when findings are searched for.
SMALL_FLOWS = 2000
#: Steps of a task's result that are held at a time.
HELD_STEPS = 100_000
#: Files are searched together in pieces of so many rows or bytes.
PIECE_ROWS = 100_000
PIECE_BYTES = 16 << 20
#: Columns of a task's result: labels, or the first tainted variable of a call.
REACHED = ["file_id", "node", *ROOT, "trace", "large"]
CALL = ["call_id", "line", "object", "method", "sink"]
FLOWS = ["file_id", *CALL, *ROOT, "trace", "large"]
#: Columns of the rows of that search, which are of several kinds, by what they are in each kind's own table.
SHARED = {
    "src": "node", "dst": "other", "sanitizer": "name", "source_type": "other", "source_line": "place", "category": "name",
    "object": "node", "method": "other", "sink": "name", "line": "place", "position": "place",
}
_STEPS = pa.struct([("first", pa.string()), ("node", pa.string()), ("sanitizer", pa.string()), ("inner", pa.int32())])


def _passing(edges: DataFrame) -> DataFrame:
    """(file_id, src, dst, sanitizer): a strong sanitizer removes its edge, an unknown one counts as none."""
    strength = lookup(SANITIZERS, F.col("sanitizer"))
    used = F.when(strength.isNotNull(), F.col("sanitizer")).otherwise("")
    kept = edges.where("src <> dst and file_id is not null").where((strength != "strong") | strength.isNull())
    return kept.select("file_id", "src", "dst", used.alias("sanitizer"))


def _live(passing: DataFrame, sources: DataFrame) -> DataFrame:
    """One edge a pair, of files with a source."""
    live = passing.join(sources.select("file_id").distinct(), "file_id", "left_semi")
    return live.groupBy("file_id", "src", "dst").agg(F.min("sanitizer").alias("sanitizer"))


def _chains(live: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The variables with one way in and one way out, and for each the start of its chain, by pointer doubling.

    ``hops`` counts the edges from ``start``, which is no such variable, and ``first`` is the
    first behind it. Each round doubles what a pointer jumps over, so a chain takes as many
    rounds as its length has bits. Rings that nothing enters stay open and are left out.
    """
    into = live.groupBy("file_id", F.col("dst").alias("node")).agg(
        F.count("*").alias("ways"), F.first("src").alias("start"), F.first("sanitizer").alias("sanitizer")
    )
    out = live.groupBy("file_id", F.col("src").alias("node")).agg(F.count("*").alias("ways"))
    inner = into.where("ways = 1").drop("ways").join(out.where("ways = 1").drop("ways"), ["file_id", "node"])
    inner = inner.join(sources.select("file_id", "node"), ["file_id", "node"], "left_anti")
    chains = cut_lineage(inner.select("file_id", "node", "sanitizer", "start", F.col("node").alias("first"), F.lit(1).alias("hops")), "chains")
    inner, still = chains.select("file_id", "node"), None
    while True:
        above = chains.select("file_id", F.col("node").alias("start"), F.col("start").alias("_s"), F.col("first").alias("_f"), F.col("hops").alias("_h"))
        jumped = chains.drop("moved").join(above, ["file_id", "start"], "left")
        chains = cut_lineage(
            jumped.select(
                "file_id", "node", "sanitizer", F.coalesce("_s", "start").alias("start"), F.coalesce("_f", "first").alias("first"),
                (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_s").isNotNull().alias("moved"),
            ),
            "chains",
        )
        moved = chains.where("moved").count()
        if moved in (0, still):
            return chains.where("not moved").drop("moved"), inner
        still = moved


def _contracted(live: DataFrame, chains: DataFrame, inner: DataFrame) -> DataFrame:
    """(file_id, src, dst, hops, step): edges between the other variables, a whole chain being one; the best of each pair."""
    ends = live.join(inner.withColumnRenamed("node", "dst"), ["file_id", "dst"], "left_anti")
    above = chains.select("file_id", F.col("node").alias("src"), "start", "first", F.col("hops").alias("inner"))
    whole = ends.join(above, ["file_id", "src"], "left")
    inner_hops = F.coalesce("inner", F.lit(0))
    step = F.struct(F.coalesce("first", "dst").alias("first"), F.col("dst").alias("node"), "sanitizer", inner_hops.alias("inner"))
    whole = whole.select("file_id", F.coalesce("start", "src").alias("src"), "dst", (inner_hops + 1).alias("hops"), step.alias("step")).where("src <> dst")
    best = F.min(F.struct("hops", "step"))
    return whole.groupBy("file_id", "src", "dst").agg(best.alias("b")).select("file_id", "src", "dst", "b.hops", "b.step")


def _extended(rows: DataFrame) -> DataFrame:
    """Labels one contracted edge or part of a chain further; ``rows`` also has ``dst``, ``more`` and ``step``."""
    shown = F.when(F.col("step.first") == F.col("step.node"), F.col("step.node")).otherwise(F.concat_ws(" ", "step.first", "step.node"))
    return rows.select(
        "file_id", F.col("dst").alias("node"), (F.col("hops") + F.col("more")).alias("hops"), F.concat_ws(" ", "key", shown).alias("key"),
        *ROOT, F.array_append("trace", F.col("step").cast(STEP)).alias("trace"),
    )


def _best(rows: DataFrame) -> DataFrame:
    """The best label of each variable."""
    rest = [c for c in rows.columns if c not in ("file_id", "node")]
    return rows.groupBy("file_id", "node").agg(F.min_by(F.struct(*rest), F.struct(*ORDER)).alias("_l")).select("file_id", "node", "_l.*")


def _ranks(values: pa.Array) -> np.ndarray:
    """The place of each value in the order of all; equal values share one, null comes first."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(codes < 0, -1, rank[codes]) if len(order) else np.full(len(codes), -1)


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Where a new group begins, in groups that lie together."""
    return np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)


def _smallest(groups: np.ndarray, lines: np.ndarray, kinds: np.ndarray, keys: Callable[[np.ndarray], pa.Array]) -> np.ndarray:
    """Index of the best row of each group by line, key and kind; texts are made and compared only where the line is shared."""
    order = np.lexsort((lines, groups))
    begins = _firsts(groups[order])
    least = lines[order][begins][np.cumsum(begins) - 1]
    order = order[lines[order] == least]
    return _least(groups, order, lambda rows: (kinds[rows], _ranks(keys(rows))))


def _least(groups: np.ndarray, order: np.ndarray, ranks: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> np.ndarray:
    """Of the rows in ``order``, which has groups together, the least of each group; the last of ``ranks`` counts first.

    Only rows that share a group are ranked.
    """
    begins = _firsts(groups[order])
    alone = begins & np.concatenate([begins[1:], [True]])
    ties = order[~alone]
    if not len(ties):
        return order
    ties = ties[np.lexsort((*ranks(ties), groups[ties]))]
    return np.concatenate([order[alone], ties[_firsts(groups[ties])]])


def _paths(paths: pa.ListArray) -> pa.Array:
    """The steps of each path as text, without nulls."""
    if paths.flatten().null_count:
        return pa.array([None if p is None else " ".join(s for s in p if s is not None) for p in paths.to_pylist()], pa.string())
    return pc.binary_join(paths, " ")


@dataclass(frozen=True)
class _Levels:
    """Variables reached in whole files; each is a pointer to the one before it.

    ``node``, ``root`` (row of the source's label), ``before``, ``edge`` and ``depth`` are by
    variable reached, the rest by row or edge. ``variable`` numbers the node of every row.
    """

    node: np.ndarray
    root: np.ndarray
    before: np.ndarray
    edge: np.ndarray
    depth: np.ndarray
    files: np.ndarray
    variable: np.ndarray
    names: pa.Array
    dst: np.ndarray
    used: pa.Array

    def traces(self, at: np.ndarray, held: int) -> Iterator[tuple[slice, pa.Array, pa.Array]]:
        """Rows of the labels of the variables ``at`` and the steps to them, in slices of at most ``held`` steps."""
        depth = self.depth[at]
        reached = np.cumsum(depth)
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(reached, (reached[begin - 1] if begin else 0) + held, "right")))
            size = depth[begin:end]
            stops = np.cumsum(size)
            step = np.empty(stops[-1], np.int64)
            now, to = at[begin:end][size > 0], stops[size > 0] - 1
            while len(now):
                step[to] = self.edge[now]
                now, to = self.before[now], to - 1
                on = self.edge[now] >= 0
                now, to = now[on], to[on]
            names, used = self.names.take(pa.array(self.dst[step])), self.used.take(pa.array(step))
            steps = pa.StructArray.from_arrays([names, names, used, pa.array(np.zeros(len(step), np.int32))], fields=list(_STEPS))
            trace = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), steps)
            yield slice(begin, end), pa.array(self.root[at[begin:end]]), trace
            begin = end


def _levels(column: dict[str, pa.Array], edges: np.ndarray, starts: np.ndarray, max_hops: int | None) -> _Levels:
    """All variables reached in whole files, all files one edge further a level.

    At each level a new variable takes the best of the labels that reach it, as ``ORDER``
    says. Rows that are neither ``edges`` nor ``starts`` only have their node numbered.
    """
    files = column["file_id"].dictionary_encode().indices.to_numpy()
    # Variables are numbered through all files; null is a name of its own that no edge has.
    ends = pa.concat_arrays([column["node"], column["dst"].take(pa.array(edges))]).dictionary_encode()
    names = pa.concat_arrays([ends.dictionary, pa.nulls(1, pa.string())])
    codes = pc.fill_null(ends.indices, len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, variable = np.unique(np.concatenate([files, files[edges]]) * np.int64(len(names)) + codes, return_inverse=True)
    name_of = pairs % len(names)
    # One edge a pair, by the variable that it leaves.
    used = column["sanitizer"].take(pa.array(edges))
    src, dst, rank = variable[edges], variable[len(files) :], _ranks(used)
    order = np.lexsort((rank, dst, src))
    order = order[_firsts(src[order] * np.int64(len(pairs)) + dst[order])]
    src, dst, used = src[order], dst[order], used.take(pa.array(order))
    ahead = np.searchsorted(src, np.arange(len(pairs) + 1))
    # The sources' own labels.
    own = {c: column[c].take(pa.array(starts)) for c in ("source_line", "path", "source_type")}
    lines, kinds, keys = _ranks(own["source_line"]), _ranks(own["source_type"]), _paths(own["path"])
    best = _smallest(variable[starts], lines, kinds, lambda rows: keys.take(pa.array(rows)))
    node, root, lines, kinds, keys = variable[starts][best], starts[best], lines[best], kinds[best], keys.take(pa.array(best))
    known = np.zeros(len(pairs), bool)
    known[node] = True
    # Levels of (variable, row of the source's label, label before, edge).
    none = np.full(len(node), -1)
    levels, total, place, hops = [(node, root, none, none)], len(node), np.arange(len(node)), 0
    while len(node) and hops != max_hops:
        ways = ahead[node + 1] - ahead[node]
        by = np.repeat(np.arange(len(node)), ways)
        edge = np.arange(len(by)) + np.repeat(ahead[node] - (np.cumsum(ways) - ways), ways)
        new = ~known[dst[edge]]
        by, edge = by[new], edge[new]
        extended = lambda rows: pc.binary_join_element_wise(
            keys.take(pa.array(by[rows])), names.take(pa.array(name_of[dst[edge[rows]]])), " ", null_handling="skip"
        )
        best = _smallest(dst[edge], lines[by], kinds[by], extended)
        keys, by, edge, hops = extended(best), by[best], edge[best], hops + 1
        node, root, lines, kinds = dst[edge], root[by], lines[by], kinds[by]
        known[node] = True
        levels.append((node, root, place[by], edge))
        total, place = total + len(node), np.arange(total, total + len(node))
    node, root, before, edge = (np.concatenate([level[i] for level in levels]) for i in range(4))
    depth = np.repeat(np.arange(len(levels)), [len(level[0]) for level in levels])
    return _Levels(node, root, before, edge, depth, files, variable, names.take(pa.array(name_of)), dst, used)


def _search_files(table: pa.Table, max_hops: int | None, held: int) -> Iterator[pa.RecordBatch]:
    """Labels of all variables reached in whole files; a row with ``dst`` is an edge, one without is a label.

    Paths of at most ``held`` steps are built at a time.
    """
    column = _columns(table)
    is_edge = _has(column["dst"])
    if is_edge.all():
        return
    found = _levels(column, np.flatnonzero(is_edge), np.flatnonzero(~is_edge), max_hops)
    for part, root, trace in found.traces(np.arange(len(found.node)), held):
        columns = {c: column[c].take(root) for c in ("file_id", *ROOT)}
        yield _result_rows(columns | {"node": found.names.take(pa.array(found.node[part])), "trace": trace}, REACHED)


def _search_flows(table: pa.Table, max_hops: int | None, held: int) -> Iterator[pa.RecordBatch]:
    """The first tainted variable of the dangerous argument of each call of a sink, in whole files, see ``_small_flows``.

    Variables are ordered by position and name; equal arguments count once, and of
    equally good calls of one id the least one.
    """
    column = _columns(table)
    of_call, is_label, named = (_has(column[c]) for c in ("call_id", "sanitizers", "name"))
    edges, labels, sinks, arguments = (np.flatnonzero(x) for x in (~of_call & ~is_label, is_label, of_call & named, of_call & ~named))
    if not (len(labels) and len(sinks) and len(arguments)):
        return
    column |= {c: column[shared] for c, shared in SHARED.items()}
    found = _levels(column, edges, labels, max_hops)
    place = np.full(len(found.names), -1)
    place[found.node] = np.arange(len(found.node))
    arguments = arguments[place[found.variable[arguments]] >= 0]
    # Calls are numbered through all files, and so are their arguments.
    rows = np.concatenate([arguments, sinks])
    code = column["call_id"].take(pa.array(rows)).dictionary_encode().indices.to_numpy()
    _, call = np.unique(found.files[rows] * np.int64(len(rows)) + code, return_inverse=True)
    _, argument = np.unique(call * np.int64(len(rows)) + _ranks(column["arg_index"].take(pa.array(rows))), return_inverse=True)
    ranked = lambda at, *names: tuple(_ranks(column[c].take(pa.array(rows[at]))) for c in names)
    together = lambda at: at[np.argsort(argument[at], kind="stable")]
    used = _least(argument, together(np.arange(len(arguments))), lambda at: ranked(at, "node", "position"))
    called = _least(argument, together(np.arange(len(arguments), len(rows))), lambda at: ranked(at, "sink", "method", "object", "line"))
    _, a, b = np.intersect1d(argument[used], argument[called], assume_unique=True, return_indices=True)
    used, called = used[a], called[b]
    best = _least(call[used], np.argsort(call[used], kind="stable"), lambda at: (argument[used[at]], *ranked(used[at], "node", "position")))
    at, called = place[found.variable[rows[used[best]]]], rows[called[best]]
    for part, root, trace in found.traces(at, held):
        columns = {c: column[c].take(pa.array(called[part])) for c in ("file_id", *CALL)}
        columns |= {c: column[c].take(root) for c in ROOT}
        yield _result_rows(columns | {"trace": trace}, FLOWS)


def _columns(table: pa.Table) -> dict[str, pa.Array]:
    table = table.combine_chunks()
    return {c: table[c].combine_chunks() for c in table.column_names}


def _has(values: pa.Array) -> np.ndarray:
    return values.is_valid().to_numpy(zero_copy_only=False)


def _result_rows(columns: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    """What was found, beside the files that are named as ``large``."""
    columns["large"] = pa.array(np.zeros(len(columns["file_id"]), bool))
    return pa.RecordBatch.from_pydict({c: columns[c] for c in names})


def _large_rows(like: pa.Table, files: pa.Array, names: list[str]) -> pa.RecordBatch:
    """A row for each file that is too large to be searched here."""
    kinds = {f.name: f.type for f in like.schema}
    columns = {c: pa.nulls(len(files), kinds.get(c) or kinds[SHARED[c]]) for c in names if c not in ("trace", "large")}
    columns |= {"file_id": files, "trace": pa.nulls(len(files), pa.list_(_STEPS)), "large": pa.array(np.ones(len(files), bool))}
    return pa.RecordBatch.from_pydict({c: columns[c] for c in names})


def _search(max_hops: int | None, most: int, held: int, flows: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by file to labels or ``flows``, in pieces of several batches; the last file of a piece waits for the next one.

    Of a file with more than ``most`` rows only its ``file_id`` is returned, and no more than a piece of it is held.
    """
    search, names = (_search_flows, FLOWS) if flows else (_search_files, REACHED)

    def searched(table: pa.Table, ended: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        """The results of a piece, then what waits."""
        files = table["file_id"].combine_chunks()
        code = files.dictionary_encode().indices.to_numpy()
        count = np.bincount(code)
        small, waits = count <= most, np.zeros(len(count), bool)
        waits[code[-1]] = not ended
        # a large file that waits is told by a few of its rows
        begins = np.flatnonzero(_firsts(code))
        large = begins[(~small & ~waits)[code[begins]]]
        if len(large):
            yield _large_rows(table, files.take(pa.array(large)), names)
        if (small & ~waits).any():
            yield from search(table.filter(pa.array((small & ~waits)[code])), max_hops, held)
        yield table.slice(begins[-1], min(int(count[code[-1]]), most + 1)) if not ended else table.slice(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(pa.Table.from_batches([batch]))
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= PIECE_ROWS or size >= PIECE_BYTES:
                *found, rest = searched(pa.concat_tables(parts).combine_chunks(), False)
                yield from found
                parts, rows, size = [rest.combine_chunks()], 0, 0
        if parts:
            *found, _ = searched(pa.concat_tables(parts).combine_chunks(), True)
            yield from found

    return run


def _small_files(passing: DataFrame, known: DataFrame, max_hops: int | None) -> DataFrame:
    """Labels of all variables reached in files of bounded size, each file in one task; larger files are named as ``large``.

    Labels without a file have no edges.
    """
    types = {f.name: f.dataType for f in known.schema}
    ways = passing.select("file_id", F.col("src").alias("node"), "dst", "sanitizer", *[F.lit(None).cast(types[c]).alias(c) for c in ROOT])
    absent = [F.lit(None).cast("string").alias(c) for c in ("dst", "sanitizer")]
    starts = known.where("file_id is not null").select("file_id", "node", *absent, *ROOT)
    rows = ways.unionByName(starts).repartition("file_id").sortWithinPartitions("file_id")
    schema = known.withColumn("large", F.lit(False)).select(*REACHED).schema
    found = rows.mapInArrow(_search(max_hops, SMALL_FILE, HELD_STEPS), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    return found.unionByName(_best(known.where("file_id is null")).withColumn("large", F.lit(False)).select(*REACHED))


def _flow_rows(passing: DataFrame, known: DataFrame, calls: DataFrame, args: DataFrame) -> DataFrame:
    """Edges, labels, calls of sinks and arguments as rows of one table, for ``_search_flows``.

    They share columns, since a batch's size is told after each row, in all columns: a label
    has ``sanitizers``, as text that nobody reads on the way, a call has ``call_id`` and a
    ``name``, which is its sink, and an argument has ``call_id`` alone.
    """
    shared = lambda *names: [F.col(c).alias(SHARED.get(c, c)) for c in names]
    ways = passing.select(*shared("file_id", "src", "dst", "sanitizer"))
    kept = F.coalesce(F.to_json("sanitizers"), F.lit("null"))
    starts = known.where("file_id is not null").withColumn("sanitizers", kept).select(*shared("file_id", "node", *ROOT))
    places = ["file_id", "call_id", "arg_index"]
    sinks = calls.dropna(subset=places).select(*shared("file_id", "arg_index", *CALL))
    used = args.dropna(subset=[*places, "node"]).select(*shared(*places, "position", "node"))
    rows = ways
    for more in (starts, sinks, used):
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def _small_flows(rows: DataFrame, like: dict[str, T.DataType], max_hops: int | None) -> DataFrame:
    """``_first_tainted`` of files of bounded size, by one shuffle of narrow rows; larger files are named as ``large``.

    Columns that were shared get their types back from ``like``.
    """
    types = {f.name: f.dataType for f in rows.schema}
    types |= {c: types[kept] for c, kept in SHARED.items()} | {"trace": like["trace"], "large": T.BooleanType()}
    rows = rows.repartition("file_id").sortWithinPartitions("file_id")
    found = rows.mapInArrow(_search(max_hops, SMALL_FLOWS, HELD_STEPS, True), T.StructType([T.StructField(c, types[c]) for c in FLOWS]))
    sanitizers = F.when(F.col("sanitizers") == "[]", F.array()).otherwise(F.from_json("sanitizers", like["sanitizers"]))
    return found.withColumns({"line": F.col("line").cast(like["line"]), "source_line": F.col("source_line").cast(like["source_line"]), "sanitizers": sanitizers})


def reach(edges: DataFrame, labels: DataFrame, max_hops: int | None = None) -> Reach:
    """Every variable that untrusted data reaches, with the label of a shortest path.

    Edges and labels of a file of bounded size meet in one task, which searches it level by
    level. Files beyond that size go through passes together, see ``_passes``; only then are
    ``edges`` and ``labels`` read again, so ``edges`` should be a table at rest.
    """
    return Reach(edges, labels, max_hops)


def _known(labels: DataFrame) -> DataFrame:
    """Labels of the sources, as a search begins with them."""
    empty = F.array().cast(f"array<{STEP}>")
    return labels.select("file_id", "node", F.lit(0).alias("hops"), F.array_join("path", " ").alias("key"), *ROOT, empty.alias("trace"))


def _searched(edges: DataFrame, labels: DataFrame, max_hops: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Labels and chains of a ``Reach``."""
    with scratch_scope(edges.sparkSession, "taint"):
        passing, known = _passing(edges), _known(labels)
        searched = cut_lineage(_small_files(passing, known, max_hops), "reached", outlives=True, codec="zstd")
        found = searched.where("not large").drop("large")
        large = searched.where("large").select("file_id")
        if large.isEmpty():
            return found, None
        passing, known = (t.join(large, "file_id", "left_semi") for t in (passing, known))
        known = cut_lineage(known, "labels", codec="zstd")
        more, chains = _passes(cut_lineage(_live(passing, known), "edges"), known, max_hops)
        return found.unionByName(cut_lineage(more, "reached", outlives=True, codec="zstd")), chains


def _passes(live: DataFrame, known: DataFrame, max_hops: int | None) -> tuple[DataFrame, DataFrame]:
    """Labels and chains of files of any size.

    Unbranched chains of assignments are contracted first, so a pass goes from branch to
    branch. A pass joins only variables whose label got better in the last one, on
    (file, variable); it ends when none did. Labels carry a step for each branch, not
    each variable; ``labelled`` rebuilds whole paths for the variables it is asked for.
    """
    chains, inner = _chains(live, known)
    chains = cut_lineage(chains, "chains", outlives=True)
    contracted = cut_lineage(_contracted(live, chains, inner).repartition("file_id", "src"), "contracted")
    frontier = known = cut_lineage(known, "starts")
    order = F.struct(*ORDER)
    while not frontier.isEmpty():
        ahead = frontier.withColumnRenamed("node", "src").join(contracted.withColumnRenamed("hops", "more"), ["file_id", "src"])
        found = _extended(ahead)
        found = _best(found.where(F.col("hops") <= max_hops) if max_hops is not None else found)
        so_far = known.groupBy("file_id", "node").agg(F.min(order).alias("_best"))
        better = found.join(so_far, ["file_id", "node"], "left").where(F.col("_best").isNull() | (order < F.col("_best"))).drop("_best")
        frontier = cut_lineage(better, "frontier")
        known = known.unionByName(frontier)
    known = cut_lineage(_best(known), "known")
    above = known.withColumnRenamed("node", "start").join(chains.withColumnsRenamed({"node": "dst", "hops": "more"}), ["file_id", "start"])
    step = F.struct("first", F.col("dst").alias("node"), "sanitizer", (F.col("more") - 1).alias("inner"))
    along = _extended(above.withColumn("step", step))
    along = along.where(F.col("hops") <= max_hops) if max_hops is not None else along
    return known.unionByName(along).drop("key", "hops"), chains


def _whole(way: str) -> list[Column | str]:
    """A label's columns with whole path and sanitizers, from the steps in the column ``way``."""
    named = F.transform(
        F.filter(way, lambda s: s["sanitizer"] != ""), lambda s: F.struct(s["sanitizer"].alias("name"), lookup(SANITIZERS, s["sanitizer"]).alias("strength"))
    )
    path = F.concat("path", F.transform(way, lambda s: s["node"]))
    return ["source_type", "source_line", "category", path.alias("path"), F.concat("sanitizers", named).alias("sanitizers")]


def labelled(found: Reach, nodes: DataFrame | None = None) -> DataFrame:
    """Labels with whole paths and sanitizers of all variables reached, or of those in ``nodes`` (file_id, node)."""
    rows = found.labels
    if nodes is not None:
        rows = rows.join(nodes.select("file_id", "node").distinct(), ["file_id", "node"], "left_semi")
    rebuilt = lambda rows, way: rows.select("file_id", "node", *_whole(way))
    if found.chains is None:
        return rebuilt(rows, "trace")
    plain = ~F.exists("trace", lambda s: s["inner"] > 0)
    steps = rows.where(~plain).select("file_id", F.col("node").alias("_target"), F.posexplode("trace").alias("_turn", "_step"))
    steps = steps.select("file_id", "_target", "_turn", "_step.*")
    inside = steps.where("inner > 0").select("file_id", "_target", "_turn", "first", "inner")
    inside = inside.join(found.chains.select("file_id", "first", "hops", "node", "sanitizer"), ["file_id", "first"]).where("hops <= inner")
    columns = ["file_id", "_target", "_turn", "hops", "node", "sanitizer"]
    every = inside.select(columns).unionByName(steps.withColumn("hops", F.col("inner") + 1).select(columns))
    way = F.sort_array(F.collect_list(F.struct("_turn", "hops", "node", "sanitizer"))).alias("_way")
    long = rows.where(~plain).join(every.groupBy("file_id", F.col("_target").alias("node")).agg(way), ["file_id", "node"])
    return rebuilt(rows.where(plain), "trace").unionByName(rebuilt(long, "_way"))


def taint_reach(edges: DataFrame, labels: DataFrame, max_passes: int | None = None) -> DataFrame:
    """``reach`` with whole paths; ``max_passes`` limits the assignments from a source."""
    return labelled(reach(edges, labels, max_passes))


def sink_key(calls_object: Column, method: Column, arg0_kind: Column, arg0_text: Column) -> Column:
    """Full name, then an SQL-like method on an SQL-like argument, then the bare name."""
    names = list(SINKS)
    method = F.coalesce(lookup(SAME_SINKS, method), method)
    full = F.concat(calls_object, F.lit("."), method)
    sql = calls_object.isNotNull() & method.isin(SQL_METHODS) & text.looks_like_sql(arg0_kind, arg0_text)
    return F.when(full.isin(names), full).when(sql, F.lit(".query")).when(method.isin(names), method)


SINK_FIELDS = ["sink", "sink_category", "vulnerability_type", "cwe_id", "severity", "taint_arg"]


def _sink_table(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        [dict(zip(SINK_FIELDS, (key, *values))) for key, values in SINKS.items()],
        "sink string, sink_category string, vulnerability_type string, cwe_id string, severity string, taint_arg int",
    )


def match_sinks(calls: DataFrame) -> DataFrame:
    key = sink_key(F.col("object"), F.col("method"), F.col("arg0_kind"), F.col("arg0_text"))
    return calls.withColumn("sink", key).join(_sink_table(calls.sparkSession), "sink")


def is_parameterized() -> Column:
    """A second argument beside a fixed statement with placeholders."""
    literal, sql = F.col("arg0_kind") == "literal", F.col("arg0_text")
    marks = sql.contains("?") | sql.contains("$1") | sql.contains(":1")
    named = (F.col("arg1_kind") == "object") & literal & (sql.contains(":") | sql.contains("$1"))
    test = (literal & marks) | (F.col("arg0_kind") == "static_template") | named
    return F.coalesce((F.col("n_args") > 1) & test, F.lit(False))


def is_safe_call() -> Column:
    """Calls whose first argument cannot be an attack."""
    category, kind, value = F.col("sink_category"), F.col("arg0_kind"), F.col("arg0_text")
    internal = value.startswith("/") & ~value.contains("//")
    test = (
        ((category == "sql_injection") & is_parameterized())
        | ((category == "xss") & kind.isin("number", "boolean"))
        | ((category == "open_redirect") & (kind == "literal") & internal)
        | ((category == "path_traversal") & (kind == "literal"))
    )
    return F.coalesce(test, F.lit(False))


def flow_record(content: Column | None = None) -> Column:
    """Source, steps and sink as JSON; step lines are counted on from the source. With the file's text each has its code."""
    def code(line: Column) -> list[Column]:
        return [] if content is None else [text.snippet_centred(content, line).alias("code")]

    steps = F.transform(
        "path",
        lambda step, i: F.struct(
            step.alias("variable"),
            (F.col("source_line") + i).alias("line"),
            *code(F.col("source_line") + i),
            F.when(i == 0, "source_access").otherwise("assignment").alias("operation"),
        ),
    )
    source = F.struct(F.col("source_type").alias("type"), F.col("source_line").alias("line"), *code(F.col("source_line")))
    callee = F.concat_ws(".", "object", "method")
    sink = F.struct(callee.alias("type"), F.col("line").alias("line"), *code(F.col("line")))
    return F.to_json(F.struct(source.alias("source"), steps.alias("propagation"), sink.alias("sink")))


def _first_tainted(calls: DataFrame, args: DataFrame, reached: DataFrame | Reach) -> DataFrame:
    """The first tainted variable of the dangerous argument, which speaks for the call."""
    used = calls.join(args, ["file_id", "call_id", "arg_index"]).select("file_id", *CALL, "position", "node")
    if isinstance(reached, Reach):
        reached = labelled(reached, None if reached.chains is None else used)
    tainted = used.join(reached, ["file_id", "node"])
    rest = [c for c in (*CALL, *ROOT) if c != "call_id"]
    first = F.min_by(F.struct(*rest), F.struct("position", "node")).alias("_row")
    return tainted.groupBy("file_id", "call_id").agg(first).select("file_id", "call_id", "_row.*")


def _first_flows(calls: DataFrame, args: DataFrame, reached: Reach) -> DataFrame:
    """``_first_tainted`` with the search in it: a file of bounded size is searched together with its calls.

    Edges, labels, calls and arguments of larger files are read again.
    """
    edges, labels = reached.edges, reached.starts
    with scratch_scope(edges.sparkSession, "flows"):
        known = _known(labels)
        like = {f.name: f.dataType for table in (known, calls) for f in table.schema}
        flows = _small_flows(_flow_rows(_passing(edges), known, calls, args), like, reached.max_hops)
        searched = cut_lineage(flows, "flows", outlives=True, codec="zstd")
        found = searched.where("not large").select("file_id", *CALL, *_whole("trace"))
        large = searched.where("large").select("file_id")
        if large.isEmpty():
            return found
    edges, labels, calls, args = (t.join(large, "file_id", "left_semi") for t in (edges, labels, calls, args))
    return found.unionByName(_first_tainted(calls, args, reach(edges, labels, reached.max_hops)))


def taint_findings(calls: DataFrame, args: DataFrame, reached: DataFrame | Reach, files: DataFrame | None = None) -> DataFrame:
    """Findings where a tainted variable sits in the dangerous argument of a sink.

    From a ``Reach`` only the paths of variables in such an argument are built. With
    ``files`` (file_id, content) findings have a snippet, and the code of source, steps and
    sink; a file without content gives none.
    """
    sinks = match_sinks(calls).where(~is_safe_call())
    dangerous = F.when(F.col("taint_arg") == LAST_ARGUMENT, F.col("n_args") - 1).when(
        F.col("taint_arg") == RIGHT_SIDE, F.lit(0)
    ).otherwise(F.col("taint_arg"))
    # What a sink's name says is looked up again at the end; only what is told from the call moves.
    narrow = sinks.select("file_id", dangerous.alias("arg_index"), *CALL)
    one = _first_flows(narrow, args, reached) if isinstance(reached, Reach) else _first_tainted(narrow, args, reached)
    one = one.join(_sink_table(calls.sparkSession), "sink")
    content = None
    if files is not None:
        one = one.join(files.select("file_id", F.col("content").alias("_content")), "file_id", "left")
        content = F.col("_content")
    has = lambda level: F.exists("sanitizers", lambda s: s["strength"] == level)
    confidence = sev.taint_confidence(F.size("path"), has("weak"), has("strong"), F.col("category"))
    return one.select(
        "file_id",
        "call_id",
        "vulnerability_type",
        "severity",
        "cwe_id",
        F.col("line").alias("line_start"),
        F.col("line").alias("line_end"),
        F.concat("vulnerability_type", F.lit(" via "), "source_type").alias("title"),
        lookup(SINK_DESCRIPTIONS, F.col("sink")).alias("description"),
        (F.lit(None).cast("string") if content is None else text.snippet_centred(content, F.col("line"))).alias("code_snippet"),
        sev.confidence_2dp(confidence).alias("confidence"),
        F.lit("sast-js").alias("analyzer_type"),
        F.concat(F.lit("flow:"), "sink").alias("rule"),
        flow_record(content).alias("data_flow"),
        F.coalesce(
            lookup(knowledge.FLOW_REMEDIATIONS, F.col("cwe_id")), F.lit(knowledge.DEFAULT_FIX)
        ).alias("remediation"),
        "sink_category",
        "source_type",
        "path",
        "sanitizers",
    )
