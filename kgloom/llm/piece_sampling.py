"""Operator 6: SentencePiece sampling without replacement, and decoding.

A text is cut before its runs of blanks into units of any length; no piece crosses
such a cut, as none has a blank after another character.  With ``join_lead`` the
blank that the format puts before a text is one run with blanks the text begins
with, as in the format; without, it is a unit of its own there.  The lattice of a
unit has a node for each character and an edge for each vocabulary piece (bytes for
characters the vocabulary lacks); the weight of a piece falls with its rank in the
vocabulary.  Sums over all paths to the end of a unit turn weights into
exact conditional probabilities, so a segmentation of the whole text is a path
with a known probability.

Distinct segmentations come from a best-first search on perturbed scores.  The
root's score is a Gumbel variable; the best path below a node has the node's
score, and all paths that leave it at one edge form a subspace whose best score is
a Gumbel variable of that subspace's mass, cut off at the node's score.  Popping
the subspace with the best score yields the next segmentation: the k best
perturbed paths are a sample without replacement.  With the next score as the
threshold, each sample gets the logarithm of its inclusion probability.

Random numbers are hashes of the row's key, the sample and the position, so a row
gives the same samples in any task, batch or retry.
"""

from __future__ import annotations

import functools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import keyed, table
from kgloom.llm.textscan import U, mix

SAMPLES = 2
ALPHA = 1.0              # exponent on the weights: 0 makes all segmentations equally likely
BATCH_CHARS = 500_000    # of the lattices that a worker holds at a time
BLANK = "▁"         # fixed by the format: stands for a blank
_LITERAL = "\ud800"      # the same character in a text; kept apart from a blank
_ZIPF = 2.7
_UNIT = re.compile(" +[^ ]*")


class Vocabulary:
    """Pieces of a model file, their log weights, and a hashed trie over characters."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = np.full(256, -1)
        self.text: list[bytes] = []
        words, rank = {}, np.full(n, float(n))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.text.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(BLANK, " ").encode())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {i} crosses a cut between units")
                words[piece] = i
                rank[i] = -sp.get_score(i) if sp.get_score(i) > -1e8 else n       # the rest: blank runs
        self.weight = -np.log(rank + _ZIPF)
        self.weight -= math.log(math.fsum(np.exp(self.weight[list(words.values())])))
        self.byte_weight = float(self.weight.min()) - 2
        self.weight[self.bytes] = self.byte_weight
        nodes, edges = {"": 0}, []
        for w in words:
            for k in range(1, len(w) + 1):
                if w[:k] not in nodes:
                    nodes[w[:k]] = len(nodes)
                    edges.append((nodes[w[:k - 1]] << 21 | ord(w[k - 1]), nodes[w[:k]]))
        self.longest = max(map(len, words))
        self.piece = np.full(len(nodes), -1)
        for w, i in words.items():
            self.piece[nodes[w]] = i
        self.mask = (1 << (len(edges) * 4).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1), np.zeros(self.mask + 1, np.int64)
        left, self.probes = np.array(edges), 0
        slot = self._slot(left[:, 0])
        while len(left):                                  # open addressing, one probe for all at a time
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.next[slot[put]] = left[put, 0], left[put, 1]
            stay = np.setdiff1d(np.arange(len(left)), put)
            left, slot, self.probes = left[stay], (slot[stay] + 1) & self.mask, self.probes + 1

    def _slot(self, key):
        return (mix(key.astype(U)) & U(self.mask)).astype(np.int64)

    def follow(self, node, char):
        """Next trie nodes, -1 where there is none."""
        key = node << 21 | char
        slot = self._slot(key)
        out = np.full(len(key), -1)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            have = self.keys[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.next[slot[hit]]
            go = ~hit & (have >= 0)
            if not go.any():
                break
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


class Lattices:
    """Lattices of distinct units, with edges in rows by node and conditional probabilities."""

    def __init__(self, v: Vocabulary, units: list[str], alpha: float):
        # Nodes are numbered by their distance to the end of their unit, so that each
        # step of the sums towards the end is one slice; node = char position + unit before.
        size = np.array([len(u) for u in units])
        char = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, begin = len(char), np.cumsum(size) - size
        unit = np.repeat(np.arange(len(units)), size)
        left = np.zeros(n + len(units), np.min_scalar_type(int(size.max())))      # short kinds sort faster
        left[np.arange(n) + unit] = (begin + size)[unit] - np.arange(n)
        order = np.argsort(left, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        count, steps = np.zeros(len(order), np.int32), []

        at, node = np.arange(n), np.zeros(n, np.int64)
        for d in range(v.longest):
            node = v.follow(node, char[at + d])
            ok = node >= 0
            at, node = at[ok], node[ok]
            pid = v.piece[node]
            full = pid >= 0
            here = number[at[full] + unit[at[full]]]
            steps.append((here, count[here], number[at[full] + unit[at[full]] + d + 1], pid[full]))
            count[here] += 1
            if d == 0:                                    # characters without a piece of their own
                lone = np.ones(n, bool)
                lone[at[full]] = False
                lone = np.flatnonzero(lone)
                here, code = number[lone + unit[lone]], char[lone]
                pid = np.where(code < 128, v.bytes[code & 127], -1 - code)      # one byte is one piece
                steps.append((here, count[here], number[lone + unit[lone] + 1], pid))
                count[here] += 1
            ok = d + 1 < left[at + unit[at]]
            at, node = at[ok], node[ok]
            if not len(at):
                break
        self.many = count
        self.row = np.zeros(len(order) + 1, np.int64)     # first edge of a node; longest edge first
        np.cumsum(count, out=self.row[1:])
        m = int(self.row[-1])
        self.src, self.dst, self.pid = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m, np.int32)
        for here, seen, there, pid in steps:
            e = self.row[here] + (count[here] - 1 - seen)
            self.src[e], self.dst[e], self.pid[e] = here, there, pid
        many = self.pid < 0
        weight = v.weight[np.where(many, 0, self.pid)]
        weight[many] = v.byte_weight * (2 + (self.pid[many] <= -1 - 0x800) + (self.pid[many] <= -1 - 0x10000))
        weight *= alpha
        beta = np.zeros(len(order))
        level = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        for lo, hi in zip(level[:-1], level[1:]):
            a, b = self.row[lo], self.row[hi]
            beta[lo:hi] = np.logaddexp.reduceat(weight[a:b] + beta[self.dst[a:b]], self.row[lo:hi] - a)
        self.logq = np.minimum(weight + beta[self.dst] - np.repeat(beta, count), 0)
        q = np.exp(self.logq)
        run = np.zeros(m + 1)
        np.cumsum(q, out=run[1:])
        self.cum = run[1:] - np.repeat(run[self.row[:-1]], count)
        inner = slice(len(units), None)                   # the ends of units come first and have no edges
        self.cum[self.row[1:][inner] - 1] = 2.0           # rounding never runs past a node's edges
        with np.errstate(divide="ignore"):
            self.logrest = np.log(-np.expm1(self.logq))
        self.logrest[self.row[:-1][inner][count[inner] == 1]] = -np.inf
        self.start = number[begin + np.arange(len(units))]
        self.is_end = np.arange(len(order)) < len(units)

    def walk(self, unit: np.ndarray, key: np.ndarray):
        """A random path through each of the units: (edges, where each unit's edges begin)."""
        cur, live, steps = self.start[unit], np.arange(len(unit)), []
        count = np.zeros(len(unit), np.int64)
        t = 0
        while len(live):
            u = (mix(key[live] ^ U(t * 0x9E3779B9 + 1)) >> U(11)).astype(np.float64) * 2.0 ** -53
            edge = self.row[cur]
            up = np.flatnonzero(self.cum[edge] <= u)
            while len(up):
                edge[up] += 1
                up = up[self.cum[edge[up]] <= u[up]]
            steps.append((live, edge))
            count[live] += 1
            cur = self.dst[edge]
            more = ~self.is_end[cur]
            live, cur = live[more], cur[more]
            t += 1
        begin = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(count, out=begin[1:])
        out = np.empty(begin[-1], np.int64)
        for t, (live, edge) in enumerate(steps):
            out[begin[live] + t] = edge
        return out, begin


def _gumbel(mu, bound, u):
    """Gumbel variables of locations mu, cut off at ``bound``."""
    return mu - np.log(np.exp(mu - bound) - np.log(u))


def _uniform(seed: int, n: int, turn: int) -> np.ndarray:
    x = mix(np.arange(n, dtype=U) + U(turn << 40) + U(seed & (2**40 - 1)), 40 + (seed >> 40 & 0xFF))
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _search(lat: Lattices, walks, lo: int, hi: int, unit, seed: int, samples: int):
    """[(path, log probability, perturbed score)] of the distinct samples of one text, and the threshold."""
    edges, begin = walks[0]
    path = edges[begin[lo]:begin[hi]]
    bound = -math.log(-math.log(_uniform(seed, 1, 99)[0]))
    found = []
    spaces = []                  # of each path: edges, log probability before each, scores of leaving, edges ruled out
    for turn in range(samples):
        if turn:
            best = max(range(len(spaces)), key=lambda k: spaces[k][2].max(initial=-np.inf))
            old, before, score, ruled = spaces[best]
            i = int(score.argmax()) if len(score) else 0
            if not len(score) or score[i] == -np.inf:
                return found, -np.inf
            bound, score[i] = float(score[i]), -np.inf
            out = ruled.get(i, frozenset()) | {int(old[i])}
            rng = random.Random(seed * 1000 + turn)
            node = int(lat.src[old[i]])
            row = int(lat.row[node])
            options = [e for e in range(row, row + int(lat.many[node])) if e not in out]
            new = rng.choices(options, [math.exp(lat.logq[e]) for e in options])[0]
            u = lo + int(lat.is_end[lat.dst[old[:i]]].sum())        # units that end before edge i
            tail = [new]
            while not lat.is_end[node := int(lat.dst[tail[-1]])]:
                r, e = rng.random(), int(lat.row[node])
                while lat.cum[e] <= r:
                    e += 1
                tail.append(e)
            edges, begin = walks[turn]
            path = np.concatenate([old[:i], tail, edges[begin[u + 1]:begin[hi]]])
            ruled = {i: out}
        else:
            i, ruled = 0, {}
        logq = lat.logq[path]
        before = np.cumsum(logq) - logq
        loc = before + lat.logrest[path]
        if turn:
            loc[:i] = -np.inf
            mass = 1 - sum(math.exp(lat.logq[e]) for e in {*ruled[i], int(path[i])})
            every = len(ruled[i]) + 1 >= int(lat.many[lat.src[path[i]]])
            loc[i] = -np.inf if every or mass <= 0 else before[i] + math.log(mass)
        score = np.full(len(path), -np.inf)
        open_ = loc > -np.inf
        score[open_] = _gumbel(loc[open_], bound, _uniform(seed, len(path), turn)[open_])
        spaces.append((path, before, score, ruled))
        found.append((path, float(logq.sum()), bound))
    return found, max((float(s[2].max(initial=-np.inf)) for s in spaces), default=-np.inf)


def _units(text: str, vocabulary_index: dict, join_lead: bool) -> list[int]:
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, _LITERAL)
    if "  " in text or join_lead and text[0] == " ":
        head = [] if join_lead or text[0] != " " else [BLANK]
        rest = text if head else " " + text
        parts = head + [p.replace(" ", BLANK) for p in _UNIT.findall(rest)]
    else:
        parts = [BLANK + p for p in text.split(" ")]
    return [vocabulary_index[p] for p in parts]


class _Index(dict):
    def __missing__(self, unit):
        self[unit] = len(self)
        return len(self) - 1


def _ids(lat: Lattices, v: Vocabulary, path) -> np.ndarray:
    pid = lat.pid[path]
    if len(pid) and pid.min() < 0:
        out = []
        for p in pid.tolist():
            out += [p] if p >= 0 else [int(v.bytes[b]) for b in _char(-1 - p).encode()]
        return np.array(out, np.int64)
    return pid


def _char(code: int) -> str:
    return BLANK if code == ord(_LITERAL) else chr(code)


def decode(v: Vocabulary, ids) -> str:
    """Text of piece ids; the blank that stands before the first unit is dropped."""
    text = b"".join([v.text[i] for i in ids])
    return text[1:].decode() if text[:1] == b" " else text.decode()


def sample_texts(v: Vocabulary, texts: list[str], seeds: list[int], samples: int = SAMPLES, alpha: float = ALPHA,
                 join_lead: bool = False):
    """For each text: [(ids, log probability, perturbed score, log inclusion probability)]."""
    index = _Index()
    units = [_units(t, index, join_lead) for t in texts]
    bounds = np.cumsum([0, *map(len, units)])
    if not index:
        return [[(np.zeros(0, np.int64), 0.0, -math.log(-math.log(_uniform(s, 1, 99)[0])), 0.0)] for s in seeds]
    unit = np.array([u for row in units for u in row], np.int64)
    lat = Lattices(v, list(index), alpha)
    size = np.diff(bounds)
    at = np.arange(len(unit)) - np.repeat(bounds[:-1], size)
    key = mix(np.repeat(np.array([s & (2**64 - 1) for s in seeds], U), size) ^ mix(at.astype(U), 50), 51)
    walks = [lat.walk(unit, mix(key, 60 + k)) for k in range(samples)]
    out = []
    for k, seed in enumerate(seeds):
        found, limit = _search(lat, walks, int(bounds[k]), int(bounds[k + 1]), unit, seed & (2**64 - 1), samples)
        rows = []
        for path, logp, score in found:
            x = logp - limit                              # log of the mean number of arrivals above the threshold
            logi = 0.0 if limit == -np.inf or x > 4 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            rows.append((_ids(lat, v, path), logp, score, logi))
        out.append(rows)
    return out


_SCHEMA = ("doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, "
           "log_inclusion double, round_trip boolean, ids array<int>")


def _run(path: str, samples: int, alpha: float, with_ids: bool, join_lead: bool = False, batch_chars: int = BATCH_CHARS):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            column, doc, seeds = batch.column("text"), batch.column("id").to_pylist(), batch.column("seed").to_pylist()
            size = [n or 0 for n in pc.utf8_length(column).to_pylist()]
            lo = 0
            while lo < len(size):
                hi, n = lo + 1, size[lo]
                while hi < len(size) and n + size[hi] <= batch_chars:
                    n, hi = n + size[hi], hi + 1
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                cols = [[] for _ in range(9)]
                for k, rows in enumerate(sample_texts(v, texts, seeds[lo:hi], samples, alpha, join_lead)):
                    for s, (ids, logp, score, logi) in enumerate(rows):
                        crc = zlib.crc32(ids.astype("<u4").tobytes())
                        same = decode(v, ids.tolist()) == texts[k]
                        for c, x in zip(cols, (doc[lo + k], s, len(ids), crc, logp, score, logi, same, ids.astype(np.int32) if with_ids else None)):
                            c.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.bool_(), pa.list_(pa.int32()))
                names = [f.split()[0] for f in _SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
                lo = hi
    return run


def sample_pieces(docs: DataFrame, model: str, samples: int = SAMPLES, alpha: float = ALPHA, with_ids: bool = True,
                  join_lead: bool = False, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """``samples`` distinct segmentations of each text, best perturbed score first.

    Output per row and sample: doc_id, sample, n_pieces, ids_crc32, log_prob,
    perturbed, log_inclusion, round_trip (the ids give the text back) and ids
    (null without ``with_ids``).  A null or empty text has one empty segmentation;
    a text with fewer segmentations than ``samples`` gives them all.  The seed is a
    hash of id and text, so equal rows give equal samples.  Other columns are ignored.
    ``join_lead`` draws from all segmentations of a text that begins with blanks.
    Lattices of ``batch_chars`` characters are held at a time: more take memory and save time.
    """
    rows = keyed(docs).select("id", "text", F.xxhash64("id", "rid").alias("seed"))
    return rows.mapInArrow(_run(model, samples, alpha, with_ids, join_lead, batch_chars), _SCHEMA)


def op6_piece_sampling(spark, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sample_pieces(table(spark, sf_dir, "documents"), model, with_ids=False, join_lead=True, batch_chars=4_000_000).drop("ids")


QUERIES = {"op6_piece_sampling": op6_piece_sampling}
SQL: dict[str, str] = {}
