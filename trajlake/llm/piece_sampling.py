"""SentencePiece segmentations without replacement: Gumbel top-k by a perturbed best-first search over the piece lattice."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import tokenizer_path

PIECES, SAMPLES, SEED = "piece_bpe_32k.model", 2, 20240229
SPACE = "▁"
#: Lattice nodes a worker keeps, characters it samples at a time, and the chunk length up to which nodes are shared by their text.
NODES, CHARS, SHARED = 1_000_000, 1_000_000, 200
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


def prepared(text: str | None) -> str:
    """The text as the model sees it: a space in front, all spaces visible; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)) for i in range(size)]
        self.text = [self.model.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.text) if plain[i]}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if self.model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() if plain[i] else b"" for i, p in enumerate(self.text)]

    def decode(self, ids: list[int]) -> str:
        """The text of any segmentation: the space in front goes."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")[1:]


_OPEN: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def _count(path: str):
    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        pieces, total, seen = _pieces(path), None, Counter()

        def add():
            nonlocal total
            words = list(seen)
            got = np.zeros(len(pieces.text), dtype=np.int64)
            for at in range(0, len(words), 5000):
                some = words[at:at + 5000]
                ids = pieces.model.encode([w[1:].replace(SPACE, " ") for w in some], num_threads=1)
                np.add.at(got, np.array([i for x in ids for i in x], dtype=np.int64), np.repeat([seen[w] for w in some], [len(x) for x in ids]))
            total = got if total is None else total + got
            seen.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(_CHUNK.findall(prepared(text)))
            if len(seen) > 300_000:
                add()
        add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])
    return count


def train_weights(docs: DataFrame, text_col: str = "text", path: str | None = None) -> list[float]:
    """Log probabilities of pieces: their counts in the plain encoding of the whole corpus, one added; as many numbers as the vocabulary has."""
    import math

    path = path or tokenizer_path(PIECES)
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    got = {r["piece"]: r["n"] for r in counts.collect()}
    size = len(_pieces(path).text)
    total = sum(got.values()) + size
    return [math.log((got.get(i, 0) + 1) / total) for i in range(size)]


class Lattice:
    """Nodes are chunk ends: a node's children are the pieces that begin it, with their probability given the node.

    Children lie one node after the other; ``upto`` holds node number plus cumulated probability, so that one sorted search
    over all of it finds the child of many nodes at once."""

    def __init__(self, pieces: Pieces, weights):
        import math

        import numpy as np

        self.np, self.pieces, self.weights, self.width, self.exp, self.log = np, pieces, weights, pieces.longest, math.exp, math.log
        self.edge_ids: list[bytes] = []
        self.edges: dict[str, tuple[int, float]] = {}
        for piece, i in pieces.ids.items():
            self.edges[piece] = (len(self.edge_ids), float(weights[i]))
            self.edge_ids.append(np.array([i], dtype="<u4").tobytes())
        self.clear()

    def clear(self) -> None:
        self.nodes: dict[str, int] = {"": 0}
        self.beta = [0.0]
        self.new: tuple[list, ...] = ([0.0], [-1], [-1], [1.0])  # node 0 is the end; it has no child of its own
        self.begin = [0, 1]
        empty = self.np.zeros(0)
        self.share, self.upto, self.next, self.edge = empty, empty, empty.astype(self.np.int64), empty.astype(self.np.int64)
        self.start = self.np.zeros(1, dtype=self.np.int64)

    def settle(self) -> None:
        """Append what has been added since the last call to the arrays."""
        np = self.np
        share, next_, edge, upto = self.new
        if share:
            self.share, self.upto = np.concatenate([self.share, share]), np.concatenate([self.upto, upto])
            self.next, self.edge = np.concatenate([self.next, np.array(next_, dtype=np.int64)]), np.concatenate([self.edge, np.array(edge, dtype=np.int64)])
            self.start = np.array(self.begin, dtype=np.int64)
            self.new = ([], [], [], [])

    def _bytes(self, char: str) -> tuple[int, float]:
        """A character outside the vocabulary is its bytes."""
        ids = [self.pieces.byte[b] for b in char.encode("utf-8", "replace")]
        self.edges[char] = (len(self.edge_ids), float(sum(self.weights[i] for i in ids)))
        self.edge_ids.append(self.np.array(ids, dtype="<u4").tobytes())
        return self.edges[char]

    def _add(self, suffix: str, ends: list[int]) -> int:
        """A node for ``suffix`` whose rest after n characters is the node ``ends[n]``."""
        beta, edges, found, top = self.beta, self.edges, [], -1e300
        for n in range(1, min(len(suffix), self.width) + 1):
            got = edges.get(suffix[:n])
            if got is None:
                if n > 1:
                    continue
                got = self._bytes(suffix[:1])
            value = got[1] + beta[ends[n]]
            found.append((value, ends[n], got[0]))
            if value > top:
                top = value
        at, exp = len(beta), self.exp
        masses = [exp(f[0] - top) for f in found]
        mass, so_far = sum(masses), float(at)
        shares, nexts, kinds, uptos = self.new
        for m, f in zip(masses, found):
            m /= mass
            so_far += m
            shares.append(m)
            nexts.append(f[1])
            kinds.append(f[2])
            uptos.append(so_far)
        uptos[-1] = at + 1.0
        beta.append(top + self.log(mass))
        self.begin.append(self.begin[-1] + len(found))
        return at

    def node(self, chunk: str) -> int:
        nodes, size = self.nodes, len(chunk)
        got = nodes.get(chunk)
        if got is not None:
            return got
        known = [0] * (size + 1)
        for i in range(size - 1, -1, -1):
            if size - i <= SHARED:
                suffix = chunk[i:]
                at = nodes.get(suffix)
                if at is None:
                    at = nodes[suffix] = self._add(suffix, known[i:i + self.width + 1])
            else:
                at = self._add(chunk[i:i + self.width], known[i:i + self.width + 1])
            known[i] = at
        return known[0]

    def children(self, node: int) -> slice:
        return slice(int(self.start[node]), int(self.start[node + 1]))


def uniform(np, seed, sample: int, word=0, step=0, use: int = 0):
    """Uniform numbers in (0, 1) from a row's seed and counters: the same whatever batch or task a row is in."""
    count = np.asarray(word, dtype=np.int64) * 1_000_003 + np.asarray(step, dtype=np.int64)
    x = seed + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((sample * 8 + use + 1) * 0xD1342543DE82EF95 % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _walk(lat: Lattice, seed, sample: int, word, node, step):
    """Sample every word to its end from where it stands: columns word, step, node, child in text order."""
    np, out = lat.np, []
    while len(word):
        u = uniform(np, seed[word], sample, word - lat.first[word], step)
        child = np.minimum(np.searchsorted(lat.upto, node + u, side="right"), lat.start[node + 1] - 1)
        out.append((word, step, node, child))
        on = lat.next[child]
        go = on > 0
        word, node, step = word[go], on[go], step[go] + 1
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    word, step, node, child = (np.concatenate(c).astype(np.int64) for c in zip(*out))
    order = np.argsort((word << 24) + step, kind="stable")
    return word[order], step[order], node[order], child[order]


def sample_texts(lat: Lattice, texts: list[str], seeds, k: int) -> list[list[tuple[bytes, int, float, float, float]]]:
    """For each text its distinct segmentations, best perturbed score first: ``ids, pieces, log probability, perturbed score, inclusion``.

    The tree's leaves are segmentations; the Gumbel of a node is the largest of its leaves'. Following the child that holds a
    node's maximum is sampling by probability, and the maximum among the children not taken is a Gumbel at their mass, cut
    off at the node's own. So each text keeps the open remainders of its paths as a frontier, takes the best ``k`` times,
    and the next one in the frontier is the threshold of the inclusion probabilities."""
    np = lat.np
    chunks = [_CHUNK.findall(prepared(t)) for t in texts]
    counts = np.array([len(c) for c in chunks])
    start = np.array([lat.node(w) for c in chunks for w in c], dtype=np.int64)
    lat.settle()
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    lat.first = begin[owner]
    word_seed = seeds[owner]
    word, step, node, child = _walk(lat, word_seed, 0, np.arange(len(start)), start, np.zeros(len(start), dtype=np.int64))
    bounds = np.searchsorted(word, begin)
    paths: list[list[dict]] = []
    for d in range(len(texts)):
        at = slice(bounds[d], bounds[d + 1])
        g = float(-np.log(-np.log(uniform(np, seeds[d:d + 1], 0, use=1)))[0])
        paths.append([_path(lat, seeds[d:d + 1], 0, word[at], step[at], node[at], child[at], 0, g)])
    for j in range(1, k):
        turns = {d: turn for d in range(len(texts)) if (turn := _turn(lat, paths[d], seeds[d:d + 1], j)) is not None}
        if not turns:
            break
        words, nodes, steps = [], [], []
        for d, (_, _, w, t, _, c, *_) in turns.items():
            on = int(lat.next[c])
            words += [np.arange(w if on else w + 1, begin[d + 1])]
            nodes += [np.array([on] if on else [], dtype=np.int64), start[w + 1:begin[d + 1]]]
            steps += [np.array([t + 1] if on else [], dtype=np.int64), np.zeros(begin[d + 1] - w - 1, dtype=np.int64)]
        fresh = _walk(lat, word_seed, j, np.concatenate(words), np.concatenate(nodes), np.concatenate(steps))
        bounds = np.searchsorted(fresh[0], begin)
        for d, (old, pos, w, t, n, c, used, left, best) in turns.items():
            at = slice(bounds[d], bounds[d + 1])
            joined = [np.concatenate([old[name][:pos], [x], tail[at]]) for name, x, tail in zip(("word", "step", "node", "child"), (w, t, n, c), fresh)]
            path = _path(lat, seeds[d:d + 1], j, *joined, pos + 1, best)
            path["taken"][pos] = used
            if left > 1e-14:
                path["rest"][pos] = _cut(np, path["before"][pos] + np.log(left), best, uniform(np, seeds[d:d + 1], j, use=3))[0]
            paths[d].append(path)
    results = []
    for found in paths:
        limit = _next(found)[2]
        rows = []
        for p in found:
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(p["total"] - limit, 50.0))))
            ids = b"".join([lat.edge_ids[e] for e in lat.edge[p["child"]].tolist()])
            rows.append((ids, len(ids) // 4, p["total"], p["g"], inclusion))
        results.append(rows)
    return results


def _turn(lat: Lattice, paths: list[dict], seed, sample: int):
    """Where the next segmentation leaves a path, the child it takes there, and the mass that stays open."""
    np = lat.np
    which, pos, best = _next(paths)
    if which is None:
        return None
    old = paths[which]
    n, own = int(old["node"][pos]), lat.children(int(old["node"][pos]))
    used = old["taken"].get(pos, {int(old["child"][pos])})
    free = lat.share[own].copy()
    free[[x - own.start for x in used]] = 0.0
    u = uniform(np, seed, sample, use=2)[0] * free.sum()
    c = own.start + min(int((np.cumsum(free) <= u).sum()), int(np.flatnonzero(free)[-1]))
    old["rest"][pos] = -np.inf
    left = float(free.sum() - lat.share[c]) if len(used) + 1 < own.stop - own.start else 0.0
    return old, pos, int(old["word"][pos]), int(old["step"][pos]), n, c, used | {c}, left, best


def _cut(np, location, upper, u):
    """A Gumbel at ``location`` given that it is at most ``upper``."""
    return location - np.log(np.exp(np.minimum(location - upper, 700.0)) - np.log(u))


def _path(lat: Lattice, seed, sample: int, word, step, node, child, fresh: int, g: float) -> dict:
    """A complete segmentation with the open remainder at each of its steps from ``fresh`` on."""
    np = lat.np
    word, step, node, child = (np.asarray(x, dtype=np.int64) for x in (word, step, node, child))
    share = lat.share[child]
    logs = np.cumsum(np.log(share))
    before = np.concatenate([[0.0], logs[:-1]]) if len(logs) else np.zeros(0)
    rest = np.full(len(share), -np.inf)
    at = fresh + np.flatnonzero((lat.start[node[fresh:] + 1] - lat.start[node[fresh:]] > 1) & (share[fresh:] < 1))
    if len(at):
        rest[at] = _cut(np, before[at] + np.log1p(-share[at]), g, uniform(np, seed, sample, word[at] - lat.first[word[at]], step[at], 4))
    return {"word": word, "step": step, "node": node, "child": child, "before": before, "rest": rest, "taken": {}, "total": float(logs[-1]) if len(logs) else 0.0, "g": g}


def _next(paths: list[dict]):
    best = (None, None, float("-inf"))
    for i, p in enumerate(paths):
        if len(p["rest"]):
            at = int(p["rest"].argmax())
            if p["rest"][at] > best[2]:
                best = (i, at, float(p["rest"][at]))
    return best


SCHEMA = "sample int, pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids binary"


def _sample(path: str, weights, k: int, seed: int):
    def sample(batches):
        import numpy as np
        import pyarrow as pa

        pieces = _pieces(path)
        lat = Lattice(pieces, weights)
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.binary())
        names = ["sample", "pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids"]
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_numpy().astype(np.int64).view(np.uint64)
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= CHARS):
                    size += len(texts[end] or "")
                    end += 1
                if len(lat.beta) > NODES:
                    lat.clear()
                got = sample_texts(lat, texts[begin:end], keys[begin:end] ^ np.uint64(seed), k)
                rows, at = [[] for _ in kinds], []
                for i, found in enumerate(got):
                    whole = prepared(texts[begin + i])[1:].replace(SPACE, " ")
                    for j, (ids, n, log_prob, g, inclusion) in enumerate(found):
                        at.append(begin + i)
                        same = pieces.decode(np.frombuffer(ids, "<u4").tolist()) == whole
                        for column, value in zip(rows, (j, n, log_prob, g, inclusion, same, ids)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(rows, kinds))], names=["id", *names])
                begin = end
    return sample


def sample_segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, seed: int = SEED, path: str | None = None) -> DataFrame:
    """Up to ``k`` rows per input row: ``id_col, sample, pieces, log_prob, perturbed, inclusion, round_trip, ids``.

    Segmentations are drawn without replacement from the unigram distribution of the corpus over all segmentations of the
    whole text: ``log_prob`` is exact and normalised, ``perturbed`` its Gumbel score (descending in ``sample``), ``inclusion``
    the probability to be drawn given the threshold, for inverse weighting. ``ids`` are little-endian 32-bit ids; characters
    outside the vocabulary are their bytes; ``round_trip`` says that decoding the ids gives the text. A visible-space
    character counts as a space. A null or empty text has one segmentation, the empty one; texts with fewer than ``k`` give
    all of theirs with inclusion 1. Draws depend on ``seed``, the id and the text only: repeated rows repeat their rows. Null
    ids are allowed, other columns ignored, an empty table gives no rows."""
    path = path or tokenizer_path(PIECES)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_sample(path, train_weights(docs, text_col, path), k, seed), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
