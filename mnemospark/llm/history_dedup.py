"""Deduplicating new batches against all history by a prefix-tree hash forest (problem 3).

A message is signed by TREES paths of min-hash digits. A tree of the forest is the
sorted permutation of all entries by (root, path); root is the user and the numbers of
the message, which have to be equal anyway. The entries of a root lie in one bucket, so
a batch reads only the buckets of its roots: a scan without shuffle of a bucketed table,
pruned to those buckets. In a bucket the entries of the batch are located by range
search at full depth, and prefixes are widened until the target recall is met or the
row is known to repeat an accepted one. Each batch appends a run; runs of like size are
merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.messages import numbers, same_message, words
from mnemospark.llm.vectors import DIMS, usable_rows
from mnemospark.session import delete_path, materialize, path_exists

TREES = 24
LEVELS = 6
LEVEL_BITS = 7
PATH_BITS = LEVELS * LEVEL_BITS
LEAST_CHARS = 25
HOT_ROWS = 100_000  # rows under one root from which it leaves the buckets for joins of its own
MOST_RUNS = 6

ROUTED = "chunk_id string, root bigint, bucket int, text string, vec binary"
PACKED = "bucket int, roots binary, rank binary, form binary, start binary, texts array<string>, vecs binary, id_start binary, ids array<string>, keys binary, perm binary, rejected array<string>, hot array<bigint>"


def paths(messages: list[list[str]]) -> np.ndarray:
    """(messages, TREES) paths of LEVELS min-hash digits of the four-character shingles, each as one integer.

    One permutation with TREES * LEVELS bins; empty bins take the value of a fixed
    sequence of other bins, so that short texts fill all.
    """
    bins = TREES * LEVELS
    raws = [(" " + " ".join(ws) + " ").encode("utf-8", "surrogatepass").ljust(4) for ws in messages]
    value = np.full((len(raws), bins), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(raws), 1_000):
        part = raws[lo : lo + 1_000]
        size = np.array([len(r) for r in part])
        c = np.frombuffer(b"".join(part), np.uint8).astype(np.uint64)
        g = c[:-3] | c[1:-2] << np.uint64(8) | c[2:-1] << np.uint64(16) | c[3:] << np.uint64(24)
        row = np.repeat(np.arange(len(part)), size)[:-3]
        inside = np.ones(len(g), bool)
        for e in np.cumsum(size)[:-1]:
            inside[e - 3 : e] = False  # shingles over the end of a text
        h, row = (g[inside] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9), row[inside]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        np.minimum.at(value[lo : lo + 1_000].reshape(-1), row * bins + (h % np.uint64(bins)).astype(np.int64), h // np.uint64(bins))
    full = value != np.iinfo(np.uint64).max
    at, empty = np.nonzero(~full)
    t = 0
    while len(empty):
        t += 1
        src = (empty * 2_654_435_761 + t * 40_503 + (t * t) * 97) % bins if t < 1_000 else (empty + t) % bins
        ok = full[at, src]
        value[at[ok], empty[ok]] = value[at[ok], src[ok]] + np.uint64(t)
        at, empty = at[~ok], empty[~ok]
    digits = (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - LEVEL_BITS)
    out = np.zeros((len(raws), TREES), np.uint64)
    for level in range(LEVELS):
        out = out << np.uint64(LEVEL_BITS) | digits.reshape(-1, TREES, LEVELS)[:, :, level]
    return out


def depth_for(recall: float, similarity: float) -> int:
    """The longest prefix by which a pair of that similarity meets in some tree with probability `recall`."""
    for k in range(LEVELS, 0, -1):
        if 1 - (1 - similarity**k) ** TREES >= recall:
            return k
    return 1


def form_of(root: int, ws: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(ws).encode("utf-8", "surrogatepass"), seed=root & 0xFFFFFFFF)


_NO_VECTOR = np.full(DIMS, np.nan, np.float32).tobytes()


def _vectors(raw: list[bytes | None]) -> np.ndarray:
    """The vectors as they came; rows of NaN where there is no usable one."""
    return np.frombuffer(b"".join(v or _NO_VECTOR for v in raw), np.float32).reshape(-1, DIMS)


def _near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Row by row: cosine of at least `least` in double precision, or no usable vector on one side."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    c = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return np.isnan(c) | (c >= least - 1e-12)


# --- one bucket --------------------------------------------------------------------------
@dataclass
class Run:
    """Accepted rows of a bucket. Rows of one root and form are one entry of the trees; its payloads differ in vector, and a payload keeps the ids of all rows equal to it."""

    roots: np.ndarray  # sorted, distinct
    rank: np.ndarray  # per entry, its place in roots
    form: np.ndarray  # per entry
    start: np.ndarray  # per entry, its first payload; one more at the end
    texts: list | pa.Array
    vecs: np.ndarray
    id_start: np.ndarray  # per payload, its first id; one more at the end
    ids: list | pa.Array
    keys: np.ndarray  # (TREES, entries), sorted: place of the root, then path
    perm: np.ndarray  # (TREES, entries): the entry of each key

    @classmethod
    def build(cls, root: np.ndarray, form: np.ndarray, ids: list, texts: list, vecs: np.ndarray, path: np.ndarray) -> Run:
        """From one row per accepted row."""
        mark = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in vecs], np.uint64)
        order = np.lexsort((mark, form, root))
        root, form, mark, vecs, path = root[order], form[order], mark[order], vecs[order], path[order]
        new_entry = np.r_[True, (root[1:] != root[:-1]) | (form[1:] != form[:-1])] if len(root) else np.zeros(0, bool)
        new_pay = new_entry | np.r_[True, mark[1:] != mark[:-1]] if len(root) else new_entry
        pay = np.flatnonzero(new_pay)
        first = np.flatnonzero(new_entry)
        roots, rank = np.unique(root[first], return_inverse=True)
        keys = rank.astype(np.uint64)[:, None] << np.uint64(PATH_BITS) | path[first]
        perm = np.argsort(keys, axis=0, kind="stable").T.astype(np.int32)
        return cls(
            roots, rank.astype(np.int32), form[first], np.searchsorted(pay, np.r_[first, len(root)]).astype(np.int32), [texts[order[i]] for i in pay], vecs[pay],
            np.r_[pay, len(root)].astype(np.int32), [ids[i] for i in order], np.take_along_axis(keys.T, perm, axis=1), perm,
        )

    @classmethod
    def load(cls, t: pa.Table, i: int) -> Run:
        get = lambda c, kind: np.frombuffer(t.column(c)[i].as_py(), kind)
        form = get("form", np.uint64)
        shape = (TREES, len(form))
        return cls(get("roots", np.int64), get("rank", np.int32), form, get("start", np.int32), t.column("texts")[i].values, get("vecs", np.float32).reshape(-1, DIMS), get("id_start", np.int32), t.column("ids")[i].values, get("keys", np.uint64).reshape(shape), get("perm", np.int32).reshape(shape))

    def row(self, bucket: int, rejected: list[str], hot: list[int]) -> dict:
        as_list = lambda x: x if isinstance(x, list) else x.to_pylist()
        return {"bucket": bucket, "roots": self.roots.tobytes(), "rank": self.rank.tobytes(), "form": self.form.tobytes(), "start": self.start.tobytes(), "texts": as_list(self.texts), "vecs": np.ascontiguousarray(self.vecs).tobytes(), "id_start": self.id_start.tobytes(), "ids": as_list(self.ids), "keys": np.ascontiguousarray(self.keys).tobytes(), "perm": np.ascontiguousarray(self.perm).tobytes(), "rejected": rejected, "hot": hot}

    def text(self, pay: int) -> str:
        t = self.texts[pay]
        return t if isinstance(t, str) else t.as_py()

    def ids_of(self, pay: int) -> list[str]:
        lo, hi = int(self.id_start[pay]), int(self.id_start[pay + 1])
        return self.ids[lo:hi] if isinstance(self.ids, list) else self.ids.slice(lo, hi - lo).to_pylist()

    def paths(self) -> np.ndarray:
        out = np.empty((len(self.form), TREES), np.uint64)
        for t in range(TREES):
            out[self.perm[t], t] = self.keys[t] & np.uint64((1 << PATH_BITS) - 1)
        return out

    def rows(self, without: set[int]) -> tuple:
        """(root, form, ids, texts, vecs, path) of every accepted row, but those of some roots: what build takes."""
        entry = np.repeat(np.arange(len(self.form)), np.diff(self.start))
        pay = np.repeat(np.arange(len(entry)), np.diff(self.id_start))
        root = self.roots[self.rank[entry[pay]]]
        keep = np.flatnonzero(~np.isin(root, list(without))) if without else np.arange(len(root))
        pay = pay[keep]
        texts = [self.text(int(p)) for p in range(len(entry))]
        ids = self.ids if isinstance(self.ids, list) else self.ids.to_pylist()
        return root[keep], self.form[entry[pay]], [ids[i] for i in keep], [texts[p] for p in pay], self.vecs[pay], self.paths()[entry[pay]]

    def same_form(self, root: np.ndarray, form: np.ndarray) -> np.ndarray:
        """The entry of each (root, form), or -1."""
        if not len(self.form):
            return np.full(len(form), -1)
        order = np.argsort(self.form, kind="stable")
        at = order[np.minimum(np.searchsorted(self.form[order], form), len(order) - 1)]
        return np.where((self.form[at] == form) & (self.roots[self.rank[at]] == root), at, -1)

    def search(self, root: np.ndarray, path: np.ndarray, depth: int) -> np.ndarray:
        """(query, entry) of all entries that share the root and a prefix of `depth` digits in some tree: a range search per tree."""
        at = np.searchsorted(self.roots, root)
        known = np.flatnonzero((at < len(self.roots)) & (self.roots[np.minimum(at, len(self.roots) - 1)] == root)) if len(self.roots) else np.zeros(0, np.int64)
        shift = np.uint64((LEVELS - depth) * LEVEL_BITS)
        found = [np.empty((0, 2), np.int64)]
        for t in range(TREES):
            lo = (at[known].astype(np.uint64) << np.uint64(PATH_BITS) | path[known, t]) >> shift << shift
            a, b = np.searchsorted(self.keys[t], lo), np.searchsorted(self.keys[t], lo + (np.uint64(1) << shift))
            n = b - a
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            found.append(np.stack([np.repeat(known, n), self.perm[t][pos]], axis=1))
        every = np.concatenate(found)
        return np.unique(every, axis=0) if len(every) else every


@dataclass
class Settings:
    least_depth: int
    least_cosine: float
    hot_rows: int


class Batch:
    """The rows of a batch in one bucket, each id once, in order of id; rows of one root and form share their candidates."""

    def __init__(self, t: pa.Table):
        t = t.take(pa.array(np.argsort(np.array(t.column("chunk_id").to_pylist(), object), kind="stable"))) if t.num_rows else t
        ids = t.column("chunk_id").to_pylist()
        keep = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        t = t.take(pa.array(keep, pa.int64()))
        self.ids = [ids[i] for i in keep]
        self.root = t.column("root").to_numpy().astype(np.int64)
        self.texts = t.column("text").to_pylist()
        self.vecs = _vectors(t.column("vec").to_pylist())
        ws = [words(x) for x in self.texts]
        self.row_form = np.array([form_of(int(r), w) for r, w in zip(self.root, ws)], np.uint64)
        _, self.lead, self.of = np.unique(np.stack([self.root.view(np.uint64), self.row_form]), axis=1, return_index=True, return_inverse=True)
        self.of = self.of.ravel()
        self.words = [ws[i] for i in self.lead]
        self.path = paths(self.words)
        by = np.argsort(self.of, kind="stable")
        self.rows_of = np.split(by, np.searchsorted(self.of[by], np.arange(1, len(self.lead))))
        self.closed = np.zeros(len(self.ids), bool)  # rejected, or an accepted row that came again
        self.rejected = np.zeros(len(self.ids), bool)

    def same(self, f: int, text: str, cache: dict, key) -> bool:
        got = cache.get((f, key))
        if got is None:
            got = cache[f, key] = same_message(self.texts[self.lead[f]], text, self.words[f])
        return got

    def meet(self, run: Run, f: int, entry: int, cache: dict, number: int, s: Settings, own: bool) -> None:
        """Close the open rows of form f that repeat an accepted row of an entry."""
        for x in self.rows_of[f]:
            if self.closed[x]:
                continue
            for pay in range(int(run.start[entry]), int(run.start[entry + 1])):
                if own and self.ids[x] in run.ids_of(pay):
                    self.closed[x] = True
                    break
                if _near(self.vecs[x : x + 1], run.vecs[pay : pay + 1], s.least_cosine)[0] and (own or self.same(f, run.text(pay), cache, (number, pay))):
                    self.closed[x] = self.rejected[x] = True
                    break

    def against(self, runs: list[Run], s: Settings) -> int:
        """Close rows that repeat history: the same form first, then by range search from full depth to the least one. Number of candidates."""
        f_root = self.root[self.lead]
        for number, run in enumerate(runs):
            hit = run.same_form(f_root, self.row_form[self.lead])
            for f in np.flatnonzero(hit >= 0):
                self.meet(run, int(f), int(hit[f]), {}, number, s, True)
        cache: dict = {}
        done = [np.empty(0, np.int64) for _ in runs]
        for depth in range(LEVELS, s.least_depth - 1, -1):
            going = np.array([f for f, xs in enumerate(self.rows_of) if not self.closed[xs].all()], np.int64)
            for number, run in enumerate(runs):
                if not len(going) or not len(run.form):
                    continue
                pairs = run.search(f_root[going], self.path[going], depth)
                f, e = going[pairs[:, 0]], pairs[:, 1]
                new = ~np.isin(f * len(run.form) + e, done[number])
                f, e = f[new], e[new]
                done[number] = np.r_[done[number], f * len(run.form) + e]
                # the commonest case at once: one row and one payload, too far apart
                single = (run.start[e + 1] - run.start[e] == 1) & np.array([len(self.rows_of[i]) == 1 for i in f], bool)
                far = np.zeros(len(f), bool)
                if single.any():
                    far[single] = ~_near(self.vecs[self.lead[f[single]]], run.vecs[run.start[e[single]]], s.least_cosine)
                for i in np.flatnonzero(~far):
                    self.meet(run, int(f[i]), int(e[i]), cache, number, s, False)
        return sum(map(len, done))

    def among(self, s: Settings) -> int:
        """Accept or reject the open rows in order of id, each against the accepted ones before it. Number of candidates."""
        going = np.array([f for f, xs in enumerate(self.rows_of) if not self.closed[xs].all()], np.int64)
        beside: dict[int, list[int]] = {}
        count = 0
        if len(going) > 1:
            root, none = self.root[self.lead[going]], np.full((len(going), DIMS), np.nan, np.float32)
            run = Run.build(root, self.row_form[self.lead[going]], list(range(len(going))), [""] * len(going), none, self.path[going])
            place = going[np.array([run.ids[int(i)] for i in run.id_start[:-1]], np.int64)]  # entry -> form
            pairs = run.search(root, self.path[going], s.least_depth)
            f, g = going[pairs[:, 0]], place[pairs[:, 1]]
            f, g = f[f < g], g[f < g]
            count = len(f)
            single = np.array([len(self.rows_of[i]) == 1 and len(self.rows_of[j]) == 1 for i, j in zip(f, g)], bool)
            near = np.ones(len(f), bool)
            if single.any():
                near[single] = _near(self.vecs[self.lead[f[single]]], self.vecs[self.lead[g[single]]], s.least_cosine)
            for i in np.flatnonzero(near):
                a, b = int(f[i]), int(g[i])
                if same_message(self.texts[self.lead[a]], self.texts[self.lead[b]], self.words[a], self.words[b]):
                    beside.setdefault(a, []).append(b)
                    beside.setdefault(b, []).append(a)
        accepted: dict[int, list[int]] = {}
        for x in np.flatnonzero(~self.closed):
            f = int(self.of[x])
            earlier = [y for g in (f, *beside.get(f, ())) for y in accepted.get(g, ())]
            if earlier and _near(np.repeat(self.vecs[x : x + 1], len(earlier), axis=0), self.vecs[earlier], s.least_cosine).any():
                self.rejected[x] = True
            else:
                accepted.setdefault(f, []).append(int(x))
        return count

    def run(self) -> Run:
        """The rows accepted for the first time."""
        k = np.flatnonzero(~self.closed & ~self.rejected)
        return Run.build(self.root[k], self.row_form[k], [self.ids[i] for i in k], [self.texts[i] for i in k], self.vecs[k], self.path[self.of[k]] if len(k) else np.empty((0, TREES), np.uint64))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


def take_in(index: pa.Table, batch: pa.Table, s: Settings, accept_all: bool) -> pa.Table:
    """One bucket: its runs and the batch's rows in, the batch's run with the rejected ids out."""
    if not batch.num_rows:
        return _arrow(PACKED).empty_table()
    b = Batch(batch)
    runs = [Run.load(index, i) for i in range(index.num_rows)]
    if not accept_all:
        b.against(runs, s)
        b.among(s)
    run = b.run()
    roots, n = np.unique(b.root, return_counts=True)
    size = dict(zip(roots.tolist(), n.tolist()))
    for r in runs:
        entries = np.repeat(r.rank, np.diff(r.start)) if len(r.form) else np.empty(0, np.int64)
        for i, c in zip(*np.unique(entries, return_counts=True)):
            if int(r.roots[i]) in size:
                size[int(r.roots[i])] += int(c)
    hot = [r for r, c in size.items() if c > s.hot_rows]
    return pa.Table.from_pylist([run.row(batch.column("bucket")[0].as_py(), [b.ids[i] for i in np.flatnonzero(b.rejected)], hot)], schema=_arrow(PACKED))


def merged(index: pa.Table, without: set[int]) -> pa.Table:
    """One bucket: its runs as one, without the roots that left the buckets; what the runs rejected is kept."""
    parts = [Run.load(index, i).rows(without) for i in range(index.num_rows)]
    columns = list(zip(*parts))
    run = Run.build(*(np.concatenate(columns[i]) for i in (0, 1)), *([x for p in columns[i] for x in p] for i in (2, 3)), *(np.concatenate(columns[i]) for i in (4, 5)))
    rejected = [x for r in index.column("rejected").to_pylist() for x in r or []]
    return pa.Table.from_pylist([run.row(index.column("bucket")[0].as_py(), rejected, [])], schema=_arrow(PACKED))


# --- the forest --------------------------------------------------------------------------
def route(chunks: DataFrame, buckets: int, *keep: str) -> DataFrame:
    """(chunk_id, root, bucket, text, vec, keep...) of the rows that can be cases: a narrow map.

    Texts under LEAST_CHARS characters, null ones and null ids are left out. A null user
    is a user of its own.
    """
    kinds = dict(chunks.dtypes)
    rows = chunks.filter(F.col("chunk_id").isNotNull() & (F.char_length("text") >= LEAST_CHARS)).select("chunk_id", "user_id", "text", "vector", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root = np.array([xxhash.xxh64_intdigest(f"{u!r} {numbers(words(t))}") >> 1 for u, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], np.int64)
            at, x = usable_rows(b.column(3))
            vec: list[bytes | None] = [None] * b.num_rows
            for i, v in zip(at, x):
                vec[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(root), pa.array((root % buckets).astype(np.int32)), b.column(2), pa.array(vec, pa.binary()), *(b.column(4 + i) for i in range(len(keep)))], names=["chunk_id", "root", "bucket", "text", "vec", *keep])

    return rows.mapInArrow(run, ", ".join([ROUTED, *(f"{k} {kinds[k]}" for k in keep)]))


class Forest:
    """A hash forest under a path: `local` has the packed runs, bucketed; `split` the rows of hot roots; `hot` their list."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, files: int | None = None, recall: float = 0.99, similarity: float = 0.6, least_cosine: float = 0.9, hot_rows: int = HOT_ROWS, most_runs: int = MOST_RUNS):
        """Open the forest at `path` or make an empty one; `buckets` and `files` must be those it was made with."""
        self.spark, self.path, self.buckets, self.files, self.most_runs = spark, path.rstrip("/"), buckets, files or max(1, buckets // 8), most_runs
        self.settings = Settings(depth_for(recall, similarity), least_cosine, hot_rows)
        self.table = f"forest_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({PACKED}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY (bucket) INTO {self.files} BUCKETS LOCATION '{self.path}/local'")
        if path_exists(spark, f"{self.path}/local"):
            spark.sql(f"MSCK REPAIR TABLE {self.table}")
        self.hot: list[int] = [r[0] for r in spark.read.parquet(f"{self.path}/hot").collect()] if path_exists(spark, f"{self.path}/hot") else []

    def runs(self) -> list[str]:
        """Names of the live runs in order. A name is a number, or first and last number of the runs merged into it, which it replaces."""
        names = sorted(r[0].partition("=")[2] for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect())
        span = {n: (n.split("_")[0], n.split("_")[-1]) for n in names}
        return [n for n in names if not any(m != n and span[m][0] <= span[n][0] and span[n][1] <= span[m][1] and len(m) > len(n) for m in names)]

    def _index(self, runs: list[str], buckets: list[int] | None = None) -> DataFrame:
        t = self.spark.table(self.table).filter(F.col("run").isin(runs))
        return t.filter(F.col("bucket").isin(buckets)) if buckets is not None else t

    def _write(self, packed: DataFrame, run: str) -> None:
        packed.withColumn("run", F.lit(run)).write.mode("append").format("parquet").partitionBy("run").bucketBy(self.files, "bucket").saveAsTable(self.table)

    def plan(self, routed: DataFrame, buckets: list[int], accept_all: bool = False) -> DataFrame:
        """The packed run of a batch: its buckets of the live runs beside its rows. The index isn't shuffled."""
        s = self.settings
        runs = self.runs()
        rows = routed.select(*ROUTED.replace(" string", "").replace(" bigint", "").replace(" int", "").replace(" binary", "").split(", "))
        if self.hot:
            rows = rows.filter(~F.col("root").isin(self.hot))
        rows = rows.repartition(self.files, "bucket")
        if accept_all and not runs:
            return rows.groupBy("bucket").applyInArrow(lambda t: take_in(_arrow(PACKED).empty_table(), t, s, True), PACKED)
        return self._index(runs, buckets).groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(lambda i, t: take_in(i, t, s, accept_all), PACKED)

    def ingest(self, routed: DataFrame, accept_all: bool = False) -> DataFrame:
        """(chunk_id) of the rejected rows of a batch; the accepted ones are history from now on. `routed` is a stored table, see route.

        Rows are taken in order of chunk_id. An id that is known already is neither
        rejected nor accepted again. With `accept_all` nothing is rejected.
        """
        run = self.take(routed, accept_all)
        out = materialize(self.rejected([run]) if run else self.spark.createDataFrame([], "chunk_id string"), "rejected")
        self.merge()
        return out

    def take(self, routed: DataFrame, accept_all: bool = False) -> str | None:
        """Decide a batch and append its run; the name of the run."""
        count = routed.groupBy("bucket", "root").count()
        seen = count.groupBy("bucket").agg(F.collect_list(F.when(F.col("count") > self.settings.hot_rows, F.col("root"))).alias("hot")).collect()  # a row per bucket
        if not seen:
            return None
        self._heat([x for r in seen for x in r["hot"]])
        run = f"{int(max((r.split('_')[-1] for r in self.runs()), default='0')) + 1:06d}"
        self._write(self.plan(routed, [r["bucket"] for r in seen], accept_all), run)
        if self.hot:
            from mnemospark.llm.hot_roots import settle_hot

            gone = settle_hot(self.spark, f"{self.path}/split", routed.filter(F.col("root").isin(self.hot)), run, self.settings, accept_all)
            gone.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{self.path}/split-rejected")
        self._heat([x for r in self._index([run]).filter(F.size("hot") > 0).select("hot").collect() for x in r["hot"]])
        return run

    def _heat(self, roots: list[int]) -> None:
        """Move the rows of roots that have become hot out of the buckets. At most rows / hot_rows of them exist."""
        new = sorted(set(roots) - set(self.hot))
        if not new:
            return
        runs = self.runs()
        if runs:
            from mnemospark.llm.hot_roots import SPLIT

            def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    t = pa.Table.from_batches([b])
                    for i in range(t.num_rows):
                        root, form, ids, texts, vecs, path = Run.load(t, i).rows(set())
                        k = np.flatnonzero(np.isin(root, new))
                        vec = [None if np.isnan(vecs[j, 0]) else vecs[j].tobytes() for j in k]
                        yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in k], pa.string()), pa.array(root[k]), pa.array(form[k].view(np.int64)), pa.array([texts[j] for j in k], pa.string()), pa.array(vec, pa.binary()), pa.array(path[k].astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["chunk_id", "root", "form", "text", "vec", "paths"])

            self._index(runs, [r % self.buckets for r in new]).mapInArrow(rows, SPLIT).withColumn("run", F.lit("moved")).write.mode("append").partitionBy("run").parquet(f"{self.path}/split")
        self.spark.createDataFrame([(r,) for r in new], "root bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/hot")
        self.hot += new

    def merge(self, everything: bool = False) -> None:
        """Merge the newest runs of like size into one, when there are more than `most_runs`. The old ones stay readable until the new one is written."""
        runs = self.runs()
        if len(runs) < 2 or not everything and len(runs) <= self.most_runs:
            return
        size = {r["run"]: r["n"] for r in self._index(runs).groupBy("run").agg(F.sum(F.size("ids")).alias("n")).collect()}
        last, total = [runs[-1]], size.get(runs[-1], 0)
        for r in reversed(runs[:-1]):
            if not everything and len(last) > 1 and size.get(r, 0) > 2 * total:
                break
            last.insert(0, r)
            total += size.get(r, 0)
        gone = set(self.hot)
        name = f"{last[0].split('_')[0]}_{last[-1].split('_')[-1]}"
        self._write(self._index(last).groupBy("bucket").applyInArrow(lambda t: merged(t, gone), PACKED), name)
        for r in last:
            self.spark.sql(f"ALTER TABLE {self.table} DROP PARTITION (run='{r}')")
            delete_path(self.spark, f"{self.path}/local/run={r}")

    def rejected(self, runs: list[str] | None = None) -> DataFrame:
        """(chunk_id) of the rows that all batches so far, or those of some runs, had rejected."""
        out = self._index(runs or self.runs()).select(F.explode("rejected").alias("chunk_id"))
        at = f"{self.path}/split-rejected"
        if self.hot and path_exists(self.spark, at):
            split = self.spark.read.schema("chunk_id string, run string").parquet(at)
            out = out.unionByName((split.filter(F.col("run").isin(runs)) if runs else split).select("chunk_id"))
        return out


def buckets_for(rows: int, bucket_rows: int = 2_048) -> int:
    return max(16, -(-rows // bucket_rows))


def by_batches(chunks: DataFrame, path: str, **options) -> DataFrame:
    """(chunk_id) of the rejected rows: batches arrive in order of batch_no, batch 0 and below being history that is accepted as it is; a null batch_no comes last.

    Rows are split by batch first, as they would arrive. Empty tables give an empty
    result; other columns are dropped.
    """
    spark = chunks.sparkSession
    forest = Forest(spark, f"{path}/forest", buckets_for(chunks.count()), **options)
    rows = chunks.withColumn("batch_no", F.coalesce("batch_no", F.lit(2**31 - 1)))
    route(rows, forest.buckets, "batch_no").withColumn("batch", F.greatest("batch_no", F.lit(0))).drop("batch_no").write.partitionBy("batch").parquet(f"{path}/arrivals")
    arrivals = spark.read.schema(ROUTED + ", batch int").parquet(f"{path}/arrivals")
    for b in sorted(r[0] for r in arrivals.select("batch").distinct().collect()):
        forest.take(arrivals.filter(F.col("batch") == b), accept_all=b == 0)
        forest.merge()
        delete_path(spark, f"{path}/arrivals/batch={b}")  # it is in the forest now
    return forest.rejected()
