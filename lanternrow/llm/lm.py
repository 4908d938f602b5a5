"""Language-model scoring by a causal self-attention model on subword ids, trained in numpy.

Subwords: words (runs without bytes 0x20, 0x09-0x0D; A-Z in lower case), each with a leading space,
by the first PIECES ranks of a public byte-level vocabulary, then one end a text. The model sees a
window of WINDOW ids, of which the last STRIDE are queries, so windows overlap by WINDOW - STRIDE
and every id is scored exactly once with at least that much context. Queries, keys and values are
learned vectors of ids; attention is masked to the past and biased by distance; its mix and the
query id's own vector give a hidden layer; the next id has a group and a place within the group,
each by a softmax. The group layout and the output biases come from the id pairs of all training texts.

Training: Adam on windows of a bounded sample (TRAIN_ROWS texts, TRAIN_BYTES) gives the start; then
one in SHARE windows of every training text, which is every one, is learned from, in ROUNDS rounds: each task goes on from
the round's model by Adam over its own windows, and the tasks' models are averaged, weighted by their
windows. So steps grow with the input.

Memory: where a run of CONTEXT words hashes to 0 modulo ANCHOR, the word after it is an anchor. All
anchors of all training texts are counted. An anchor of probability p by attention (the product of
its ids') gets (c + K p) / (t + K), where the run stands t times in the training texts and c times
with that word after it; a training text's own occurrence doesn't count. So what the model has from
the corpus grows with it, and repeated texts score apart.

Word and anchor counts cover all training texts: every block of texts lists its different words and
anchors, counts are summed over all blocks and dealt back to the blocks that asked, as a file a block
in the shared folder. So a word costs a row a block, not a row an occurrence, and no task holds more
than a block's words; the rows of the commonest word are as many as there are blocks.

Null and empty texts are their end alone. Rows that repeat are counted and scored each. With no
training text, counts are 0 and the model is the untrained one.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .bpe import read_ranks
from .tables import sampled, shared_folder, stored
from .warc import filesystem
from .words import SPACED, Texts, Words, mix, slices

GROUPS, PLACES = 32, 64
PIECES = GROUPS * PLACES - 1
END = PIECES
WINDOW, STRIDE = 32, 24
BACK = WINDOW - STRIDE
KEY, VALUE, HIDDEN = 8, 16, 24
TRAIN_ROWS, TRAIN_BYTES, STEPS, BATCH, RATE = 1500, 16 << 20, 1000, 96, 0.01
#: Passes over disjoint shares of the training texts, windows of one step in them, and windows of a text for one that is learned from (1: all are).
ROUNDS, ROUND_BATCH, SHARE = 4, 192, 1
#: Words of a run that an anchor follows, runs for one anchor, and the weight of attention in counts.
CONTEXT, ANCHOR, K = 3, 16, 2.0
#: Models averaged in one group.
AVERAGED = 16
#: Windows scored in one batch.
AT_ONCE = 256
#: Words whose ids are held in memory at once; a cache, emptied when full.
CACHE = 500_000
#: Bytes of text whose words share a dictionary.
BLOCK_BYTES = 32 << 20
_DISTANCE = BACK + np.arange(STRIDE)[:, None] - np.arange(WINDOW)[None, :]
_PAST = _DISTANCE >= 0


class _Known(dict):
    """Ids of words as bytes of 16-bit numbers, made when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = array("H", self.encode(" " + word.decode("utf-8", "replace"))).tobytes()
        self[word] = ids
        return ids


class Pieces:
    """Subword ids of words."""

    def __init__(self, ranks_path: str, n: int = PIECES):
        import tiktoken

        tokens = read_ranks(ranks_path)[:n]
        #: Whether an id begins a word: only a word's first piece has the space.
        self.begins = np.array([t[:1] == b" " for t in tokens] + [False] * (GROUPS * PLACES - len(tokens)))
        model = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        self.known = _Known(model.encode_ordinary)

    def sequence(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by END, and the rows' first places. texts are in lower case."""
        data, known, end = texts.data.tobytes(), self.known, array("H", [END]).tobytes()
        rows = []
        for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
            if len(known) > CACHE:
                known.clear()
            # split() cuts at the same bytes as SPACED
            rows.append(b"".join(map(known.__getitem__, data[a:b].split())) + end)
        size = np.fromiter(map(len, rows), np.intp, len(rows)) // 2
        return np.frombuffer(b"".join(rows), np.uint16).astype(np.intp), np.cumsum(size) - size


@cache
def pieces_of(ranks_path: str) -> Pieces:
    """The Pieces of a process: later tasks find the words of earlier ones."""
    return Pieces(ranks_path)


def windows_of(ids: np.ndarray, first: np.ndarray, start: np.ndarray | int = 0, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, row) of the windows of all rows, or of each step-th of a row from its start on; the place before a row is END, targets beyond it are -1."""
    total = np.diff(np.append(first, len(ids)))
    count = np.maximum(-(-(-(-total // STRIDE) - start) // step), 0)
    row = np.repeat(np.arange(len(first)), count)
    at = ((np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * step + np.broadcast_to(start, len(first))[row]) * STRIDE
    place = at[:, None] + np.arange(-BACK, STRIDE)[None, :] - 1  # of inputs; target t follows input t - 1
    size, base = total[row][:, None], first[row][:, None]
    inputs = np.where((place >= 0) & (place < size), ids[np.clip(base + place, 0, len(ids) - 1)], END)
    want = at[:, None] + np.arange(STRIDE)[None, :]
    targets = np.where(want < size, ids[np.clip(base + want, 0, len(ids) - 1)], -1)
    return inputs, targets, row


def layout(pair: np.ndarray) -> np.ndarray:
    """group * PLACES + place of each id: ids that follow alike ones share a group; equal parts by halving. pair[a, b] counts b after a."""
    n = GROUPS * PLACES
    pair = np.sqrt(pair.astype(np.float32)) / np.sqrt(pair.sum(0) + 1)[None, :]
    draw = np.random.default_rng(3).standard_normal((n, 8)).astype(np.float32)
    for _ in range(6):
        draw, _ = np.linalg.qr(pair.T @ (pair @ draw))
    axes, parts, depth = draw, [np.arange(n)], 0
    while len(parts[0]) > PLACES:
        # an axis of each part that spreads it the most
        parts = [half for p in parts for half in np.split(p[np.argsort(axes[p][:, np.argmax(axes[p].std(0))], kind="stable")], 2)]
        depth += 1
    out = np.empty(n, np.int64)
    out[np.concatenate(parts)] = np.arange(n)
    return out


class Attention:
    def __init__(self, where: np.ndarray, seed: int = 5):
        draw, n = np.random.default_rng(seed), GROUPS * PLACES
        make = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
        self.where, self.ready = where, None
        self.p = {
            "q": make(n, KEY, by=0.3), "k": make(n, KEY, by=0.3), "v": make(n, VALUE, by=0.3), "own": make(n, HIDDEN, by=0.3), "far": np.linspace(0, -2, WINDOW, dtype=np.float32),
            "mix": make(VALUE, HIDDEN, by=0.2), "bias": np.full(HIDDEN, 0.1, np.float32), "group": make(HIDDEN, GROUPS, by=0.1), "gb": np.zeros(GROUPS, np.float32),
            "place": make(GROUPS, HIDDEN, PLACES, by=0.05), "pb": np.zeros((GROUPS, PLACES), np.float32),
        }

    def prior(self, count: np.ndarray) -> None:
        """Biases from the frequencies of ids."""
        n = np.bincount(self.where, count, GROUPS * PLACES).reshape(GROUPS, PLACES) + 0.1
        self.p["gb"] = np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.p["pb"] = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    def _hidden(self, x: np.ndarray):
        p = self.p
        late = x[:, BACK:]
        q, k, v = p["q"][late], p["k"][x], p["v"][x]
        s = q @ k.transpose(0, 2, 1)
        s += np.where(_PAST, p["far"][np.maximum(_DISTANCE, 0)], np.float32(-1e4))
        np.minimum(s, 60, out=s)  # as in log_probs
        np.exp(s, out=s)
        s /= (s @ np.ones(WINDOW, s.dtype))[:, :, None]
        c = s @ v
        h = (c.reshape(-1, VALUE) @ p["mix"] + p["own"][late].reshape(-1, HIDDEN)) + p["bias"]
        return late, q, k, v, s, c, h

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target, 0 where it is -1."""
        p, w = self.p, len(x)
        if self.ready is None:
            ones = np.concatenate([p["v"], np.ones((len(p["v"]), 1), np.float32)], 1)
            bias = np.where(_PAST, p["far"][np.maximum(_DISTANCE, 0)], np.float32(-1e4))
            table = np.concatenate([p["k"], ones, p["q"], p["own"]], 1)
            self.ready = table, bias, np.concatenate([p["place"], p["pb"][:, None, :]], 1), np.concatenate([p["group"], p["gb"][None, :]], 0), np.concatenate([p["mix"], np.zeros((1, HIDDEN), np.float32)], 0)
        table, bias, place_of, group_of, mix = self.ready
        every = table.take(x, 0)
        keys, values, query, own = np.split(every, [KEY, KEY + VALUE + 1, 2 * KEY + VALUE + 1], 2)
        s = np.matmul(query[:, BACK:], keys.transpose(0, 2, 1))
        s += bias
        if s.max() > 60:  # far beyond what training gives, so that exp stays finite
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        c = np.matmul(s, values).reshape(-1, VALUE + 1)
        c /= c[:, -1:]
        h = np.empty((w * STRIDE, HIDDEN + 1), np.float32)
        h[:, -1] = 1
        part = h[:, :-1]
        np.add(c @ mix, own[:, BACK:].reshape(-1, HIDDEN), out=part)
        part += p["bias"]
        np.maximum(part, 0, out=part)
        want = y.reshape(-1)
        at = np.flatnonzero(want >= 0)
        slot = self.where[want[at]]
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        at, slot = at[order], slot[order]
        h, group, place = h.take(at, 0), slot // PLACES, slot % PLACES
        z = h @ group_of
        chosen = z[np.arange(len(z)), group]
        out = chosen - _log_total(z)
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        inner = np.empty((len(at), PLACES), np.float32)
        for g in range(GROUPS):
            if ends[g + 1] > ends[g]:
                np.matmul(h[ends[g] : ends[g + 1]], place_of[g], out=inner[ends[g] : ends[g + 1]])
        out += inner[np.arange(len(at)), place]
        out -= _log_total(inner)
        full = np.zeros(len(want), np.float32)
        full[at] = out
        return full.reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability of the targets."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        late, q, k, v, s, c, raw = self._hidden(x)
        h, want = np.maximum(raw, 0), y.reshape(-1)
        at = np.flatnonzero(want >= 0)
        slot = self.where[want[at]]
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        at, slot = at[order], slot[order]
        ha, group, place = h[at], slot // PLACES, slot % PLACES
        e = _shares(ha @ p["group"] + p["gb"])
        e[np.arange(len(at)), group] -= 1
        e /= len(at)
        g["group"], g["gb"] = ha.T @ e, e.sum(0)
        back = e @ p["group"].T
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for n in np.unique(group).tolist():
            own = slice(ends[n], ends[n + 1])
            e = _shares(ha[own] @ p["place"][n] + p["pb"][n])
            e[np.arange(len(e)), place[own]] -= 1
            e /= len(at)
            g["place"][n], g["pb"][n] = ha[own].T @ e, e.sum(0)
            back[own] += e @ p["place"][n].T
        dh = np.zeros_like(h)
        dh[at] = back
        dh *= raw > 0
        g["bias"] = dh.sum(0)
        g["mix"] = c.reshape(-1, VALUE).T @ dh
        dc = (dh @ p["mix"].T).reshape(c.shape)
        ds = dc @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ dc
        ds *= s
        ds -= s * (ds @ np.ones(WINDOW, ds.dtype))[:, :, None]
        _scatter(late, {"own": dh, "q": ds @ k}, g)
        _scatter(x, {"v": dv, "k": ds.transpose(0, 2, 1) @ q}, g)
        np.add.at(g["far"], np.maximum(_DISTANCE, 0).reshape(-1), (ds.sum(0) * _PAST).reshape(-1))
        return g


def _scatter(ids: np.ndarray, rows: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
    """Sums rows by their id into g, by one sort of the ids."""
    ids = ids.reshape(-1)
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    for name, part in rows.items():
        g[name][ids[starts]] = np.add.reduceat(part.reshape(len(ids), -1)[order], starts, 0)


def _log_total(z: np.ndarray) -> np.ndarray:
    """_log_sum in place, without a pass for the largest unless it is needed."""
    if z.size and z.max() > 80:
        return _log_sum(z)
    np.exp(z, out=z)
    return np.log(z @ np.ones(z.shape[1], np.float32))


def _shares(z: np.ndarray) -> np.ndarray:
    """Softmax of rows, in place."""
    if z.size and max(z.max(), -z.min()) > 80:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


class _Adam:
    def __init__(self, model: Attention):
        self.model, self.t = model, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.r = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        self.t += 1
        m, r, t = self.m, self.r, self.t
        rate *= min(1, t / 30)
        for name, d in self.model.gradients(x, y).items():
            m[name] += 0.1 * (d - m[name])
            r[name] += 0.01 * (d * d - r[name])
            self.model.p[name] -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(r[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def fit(texts: list[str], pieces: Pieces, pair: np.ndarray, steps: int = STEPS, seed: int = 5) -> Attention:
    """The start: layout and biases of all id pairs, then Adam over random windows of texts; the step size falls to nothing."""
    if not pair.any():
        return Attention(np.arange(GROUPS * PLACES))
    model = Attention(layout(pair), seed)
    model.prior(pair.sum(0))
    parts = []
    for _, _, part in slices(pa.array(texts, pa.large_string())):
        parts.append(windows_of(*pieces.sequence(part.lower()))[:2])
    if not parts:
        return model
    x, y = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    draw, adam = np.random.default_rng(seed), _Adam(model)
    for t in range(1, min(steps, 20 + 10 * len(x)) + 1):
        take = draw.integers(0, len(x), BATCH)
        adam.step(x[take], y[take], RATE * (1 - t / (steps + 1)))
    return model


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' ids and the rows' bounds in them."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(np.uint16), (bounds - bounds[0]) // 2


def id_pairs(blocks: DataFrame) -> np.ndarray:
    """How often id b follows id a in all training texts, by [a, b]; END stands before each text."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    n = GROUPS * PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(n * n, np.int64), [], 0
        for batch in batches:
            ids, before = _ids(batch.column(0))[0] if batch.num_rows else (), END
            for a in range(0, len(ids), 1 << 20):
                part = ids[a : a + (1 << 20)].astype(np.int32)
                held.append(np.append(before, part[:-1]).astype(np.int32) * n + part)
                before, size = part[-1], size + len(part)
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=n * n)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=n * n)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    # at most n * n rows, read by file so that they don't pass through the driver's JVM
    folder = shared_folder(blocks.sparkSession, "pairs")
    blocks.filter("train").select("ids").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).write.parquet(folder)
    out, (fs, root) = np.zeros(n * n, np.int64), filesystem(folder)
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.path.endswith(".parquet"):
            got = pq.ParquetFile(fs.open_input_file(f.path)).read()
            out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n, n)


def learn(blocks: DataFrame, model: Attention) -> int:
    """Trains model on one in SHARE windows of every training text, one at least, beginning at a place drawn by its doc_id; the number of windows."""
    sizes = {k: v.size for k, v in model.p.items()}
    seen = 0
    for turn in range(ROUNDS):
        rate = RATE * 0.3 * (1 - turn / ROUNDS)
        draw_of = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        own = blocks.filter("train").filter(F.pmod(draw_of, F.lit(ROUNDS)) == turn).select("ids", F.pmod(F.shiftright(draw_of, 8), F.lit(SHARE)).alias("from"))

        def run(batches: Iterator[pa.RecordBatch], rate=rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            adam, draw, windows = _Adam(model), np.random.default_rng(7), 0
            left = np.zeros((0, WINDOW), np.intp), np.zeros((0, STRIDE), np.intp)
            for batch in batches:
                if not batch.num_rows:
                    continue
                (ids, bounds), start = _ids(batch.column(0)), np.asarray(batch.column(1)).astype(np.int64)
                # a text of fewer windows than SHARE gives one of them
                start %= np.minimum(-(-np.diff(bounds) // STRIDE), SHARE)
                i = 0
                while i < batch.num_rows:
                    j = min(max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 17), side="right")) - 1), batch.num_rows)
                    x, y, _ = windows_of(ids[bounds[i] : bounds[j]].astype(np.intp), bounds[i:j] - bounds[i], start[i:j], SHARE)
                    x, y, i = np.concatenate([left[0], x]), np.concatenate([left[1], y]), j
                    order = draw.permutation(len(x))
                    full = len(x) // ROUND_BATCH * ROUND_BATCH
                    for a in range(0, full, ROUND_BATCH):
                        take = order[a : a + ROUND_BATCH]
                        adam.step(x[take], y[take], rate)
                    windows += full
                    left = x[order[full:]], y[order[full:]]
            if len(left[0]):
                adam.step(*left, rate)
                windows += len(left[0])
            if windows:
                names, parts = list(sizes), [adam.model.p[k].astype(np.float32).tobytes() for k in sizes]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([task] * len(names), pa.int32()), pa.array([windows] * len(names), pa.int64()), pa.array(parts, pa.binary())], names=["name", "task", "windows", "value"])

        def mean(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("task")
            n = rows.column("windows").to_pylist()
            total = np.zeros(sizes[rows.column("name")[0].as_py()])
            for w, v in zip(n, rows.column("value"), strict=True):
                total += w * np.frombuffer(v.as_py(), np.float32).astype(np.float64)
            return pa.table({"name": rows.column("name").slice(0, 1), "task": pa.array([rows.column("task")[0].as_py() // AVERAGED], pa.int32()), "windows": pa.array([sum(n)], pa.int64()), "value": pa.array([(total / sum(n)).astype(np.float32).tobytes()], pa.binary())})

        # a tree of means, of AVERAGED models each
        done, left_over = own.mapInArrow(run, "name string, task int, windows long, value binary"), own.rdd.getNumPartitions()
        while True:
            done = done.groupBy("name", F.expr(f"task div {AVERAGED}")).applyInArrow(mean, "name string, task int, windows long, value binary")
            left_over = -(-left_over // AVERAGED)
            if left_over <= 1:
                break
        got = done.collect()
        for r in got:
            model.p[r["name"]] = np.frombuffer(r["value"], np.float32).reshape(model.p[r["name"]].shape).copy()
        seen += got[0]["windows"] if got else 0
    return seen


def _blocks(docs: DataFrame, doc_id: str, text: str, train: Column, ranks_path: str) -> DataFrame:
    """doc_id, text, train, block, ids: texts written out with the block whose dictionary they share, and their ids as 16-bit numbers."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.spark_partition_id().alias("part"))
    schema = StructType([*source.schema.fields[:3], StructField("block", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, block, held = pieces_of(ranks_path), 0, 0
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0
                held += len(texts.data)
                name = pa.array(np.asarray(batch.column(3).slice(i, j - i)).astype(np.int64) * (1 << 24) + block)
                ids, first = pieces.sequence(texts.lower())
                where = np.append(first, len(ids)) * 2
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(ids.astype(np.uint16))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), name, packed], names=schema.names)

    return stored(source.mapInArrow(run, schema), "blocks", "zstd")


def anchors(words: Words, hashes: np.ndarray, every: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, hash of the run before it, 31 bits of the word, not 0) of each anchor."""
    run, at = words.windows(hashes, CONTEXT, salt=11)
    keep = np.flatnonzero(run % np.uint64(every) == 0)
    run, word = run[keep], at[keep] + CONTEXT
    inside = word < np.repeat(words.rows[1:], words.counts())[at[keep]]
    run, word = run[inside], word[inside]
    return word, run, ((hashes[word] >> np.uint64(33)) | np.uint64(1)).astype(np.int32)


def word_counts(blocks: DataFrame) -> DataFrame:
    """hash, next, block, n: how often each word (next is 0) and each anchor (hash of its run, and next of its word) stands in the training texts (n) of a block that has it at all."""
    source = blocks.select("text", "train", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        block, rows = None, 0

        def merged():
            key, after, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key ^ mix(after.astype(np.uint64)))
            key, after, n = key[order], after[order], n[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (after[1:] != after[:-1])))[: len(key)]
            return key[first], after[first], np.add.reduceat(n, first) if len(key) else n

        def out(key, after, n, b):
            for a in range(0, len(key), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(after[part]), pa.array(np.full(len(key[part]), b)), pa.array(n[part])], names=["hash", "next", "block", "n"])

        for batch in batches:
            for i, j, texts in slices(batch.column(0)):
                names = np.asarray(batch.column(2).slice(i, j - i))
                train = np.asarray(batch.column(1).slice(i, j - i).cast(pa.int8())).astype(np.int64)
                words = texts.lower().words(SPACED)
                hashes, row = words.hashes(), np.repeat(np.arange(j - i), words.counts())
                word, before, after = anchors(words, hashes, ANCHOR)
                for b in np.unique(names).tolist():
                    if b != block and held:
                        yield from out(*merged(), block)
                        held, rows = [], 0
                    block = b
                    own, some = names[row] == b, names[row[word]] == b
                    u, back = np.unique(hashes[own], return_inverse=True)
                    held.append((u, np.zeros(len(u), np.int32), np.bincount(back, train[row[own]], len(u)).astype(np.int64)))
                    held.append((before[some], after[some], train[row[word[some]]]))
                    rows += len(u) + int(some.sum())
                    if rows > 2_000_000:
                        held = [merged()]
                        rows = len(held[0][0])
        if held:
            yield from out(*merged(), block)

    return source.mapInArrow(run, "hash long, next int, block long, n long")


def dictionary(counted: DataFrame, folder: str) -> DataFrame:
    """Writes word_counts with their sums to folder, a folder a block: hash, next, c (of the word or anchor), t (of all anchors of its run), first (true in one of its blocks).

    Anchors whose run stands nowhere else in the training texts tell nothing and are left out.
    Returns one row: n words in all, v different ones, both in the training texts.
    """
    names = ["block", "hash", "next", "c", "t", "first"]

    def summed(rows: pa.Table) -> pa.RecordBatch:
        key, after, block, n = (rows.column(k).to_numpy() for k in range(4))
        order = np.lexsort((after, key))
        key, after, block, n = key[order], after[order], block[order], n[order]
        new = np.append(True, key[1:] != key[:-1])
        run, one = np.flatnonzero(new), np.flatnonzero(new | np.append(True, after[1:] != after[:-1]))
        spread = lambda first: np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(n))))
        c, t, lead = spread(one), spread(run), np.zeros(len(n), bool)
        lead[one] = True
        keep = (after == 0) | (t > 1) | ((t == 1) & (n == 0))
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (block, key, after, c, t, lead)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 200_000 or batch.column(0)[0] == batch.column(0)[-1]:
                continue
            # the last hash goes on in the next batch
            cut = int(np.searchsorted(batch.column(0).to_numpy(), batch.column(0)[-1].as_py()))
            yield summed(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield summed(pa.Table.from_batches(held))

    rows = counted.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "block long, hash long, next int, c long, t long, first boolean")
    rows.repartition("block").write.partitionBy("block").parquet(folder)
    # a word stands once a block there; one of them tells its count to the totals
    written = counted.sparkSession.read.schema("hash long, next int, c long, t long, first boolean, block long").parquet(folder)
    return written.filter("first and c > 0 and next = 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"))


def score_documents(docs: DataFrame, ranks_path: str, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_pieces. train is a condition over docs."""
    spark = docs.sparkSession
    sample = sampled(docs.filter(train), text, TRAIN_ROWS, TRAIN_BYTES, doc_id)
    blocks = _blocks(docs, doc_id, text, train, ranks_path)
    pieces = Pieces(ranks_path)
    model, begins = fit(sample, pieces, id_pairs(blocks)), pieces.begins
    learn(blocks, model)
    folder = shared_folder(spark, "dictionary")
    totals = dictionary(word_counts(blocks), folder).first()
    ends = blocks.filter("train").count()
    n, v = (totals.n or 0) + ends, totals.v + bool(ends)
    total = np.log10(n + 0.1 * (v + 1))
    end_part = np.log10(ends + 0.1) - total

    schema = StructType([blocks.schema["doc_id"], StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType()), StructField("n_pieces", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, root = filesystem(folder)
        none = np.zeros(0, np.uint64), np.zeros(0)
        block, (keys, count), (runs, pairs, total_of) = None, none, (*none, np.zeros(0))

        def lookup(b: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
            """(words, counts), (anchors, c, t) of a block, both sorted."""
            from pyarrow import fs as pafs

            at = f"{root}/block={b}"
            files = [f.path for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
            tables = [pq.ParquetFile(fs.open_input_file(f)).read(columns=["hash", "next", "c", "t"]) for f in files]
            if not tables:
                return none, (*none, np.zeros(0))
            rows = pa.concat_tables(tables)
            k, after, c = rows.column("hash").to_numpy().view(np.uint64), rows.column("next").to_numpy(), rows.column("c").to_numpy().astype(np.float64)
            t = rows.column("t").fill_null(0).to_numpy().astype(np.float64)
            word = after == 0
            order = np.argsort(k[word])
            anchor = anchor_key(k[~word], after[~word])
            by = np.argsort(anchor)
            return (k[word][order], c[word][order]), (anchor[by], c[~word][by], t[~word][by])

        def found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
            return at, sorted_keys[at] == wanted

        for batch in batches:
            names = np.asarray(batch.column(3))
            if not len(names):
                continue
            every, bounds = _ids(batch.column(4))
            for i, j, texts in slices(batch.column(1), 1 << 18):
                texts = texts.lower()
                words = texts.words(SPACED)
                hashes = words.hashes()
                ids, first = every[bounds[i] : bounds[j]].astype(np.intp), bounds[i:j] - bounds[i]
                row = np.repeat(np.arange(j - i), words.counts())
                learnt = np.asarray(batch.column(2).slice(i, j - i).cast(pa.int8())).astype(bool)
                x, y, _ = windows_of(ids, first)
                # targets in the order of windows are the ids in their order
                each = np.concatenate([model.log_probs(x[a : a + AT_ONCE], y[a : a + AT_ONCE])[y[a : a + AT_ONCE] >= 0] for a in range(0, len(x), AT_ONCE)]).astype(np.float64)
                starts = np.flatnonzero(begins[ids] | (ids == END))
                part = np.add.reduceat(each, starts)
                is_end = ids[starts] == END
                score, spelt = part[is_end], part[~is_end]
                word, before, after = anchors(words, hashes, ANCHOR)
                known = np.zeros(len(hashes), bool)
                base = np.zeros(j - i)
                for b in np.unique(names[i:j]).tolist():
                    if b != block:
                        block = b
                        (keys, count), (runs, pairs, total_of) = lookup(b)
                    if len(keys):
                        own = np.flatnonzero(names[i:j][row] == b)
                        different, back = np.unique(hashes[own], return_inverse=True)
                        at, same = found(keys, different)
                        c = np.where(same, count[at], 0.0)
                        known[own] = (c > 0)[back]
                        base += np.bincount(row[own], np.log10(c + 0.1)[back], j - i)
                    if len(runs):
                        own = np.flatnonzero(names[i:j][row[word]] == b)
                        at, same = found(runs, anchor_key(before[own], after[own]))
                        own, at = own[same], at[same]
                        mine = learnt[row[word[own]]]
                        spelt[word[own]] = np.log((pairs[at] - mine + K * np.exp(spelt[word[own]])) / (total_of[at] - mine + K))
                base += end_part - words.counts() * total
                score = score + np.bincount(row, spelt, j - i)
                columns = [pa.array(~learnt), pa.array(words.counts() + 1), pa.array(np.bincount(row[known], minlength=j - i) + (ends > 0)), pa.array(np.full(j - i, n)), pa.array(base), pa.array(score / np.log(10)), pa.array(np.diff(np.append(first, len(ids))))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=schema.names)

    return blocks.mapInArrow(run, schema)


def anchor_key(run: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One number for a run and the word after it."""
    return mix(run ^ mix(after.astype(np.uint64)))
