"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans of four kinds; they always stay. Every other mention that looks like one of the
kinds (digits in groups, a handle with an @, an address's name on its own) is a node of a graph over the
document, as are the base spans. Skip edges join mentions that repeat each other, and mentions that resemble
each other (by their last ten digits, or one edit apart), however far apart; chain edges join neighbours. Loopy
sum-product message passing over the whole document, with base mentions fixed, labels the rest; what gets
a kind becomes a span, so labels of one entity agree.

Weights of nodes, of each sort of skip edges and of chain edges are learnt together by pseudo-likelihood on
a bounded sample of the documents: base mentions carry their kind, mentions that no skip edge leads from
to a base one are outside, and what is between is hidden. Half of the nodes are trained without their
features, so that their neighbours must explain them; edges have a prior of EDGE_PRIOR.

Edges run from a mention to the next of its like, so their number is linear in the mentions.

Defined cases: null texts are empty and have no spans; texts of any length are searched whole; offsets are
code points, ends exclusive; of equally probable labels the first kind in KINDS wins, outside last; an
empty table gives no rows and a model of priors. Repeated rows repeat; extra columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Bounds of the fit: documents sampled and code points of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20000
MAX_ROUNDS, TOLERANCE = 50, 1e-6
#: Sorts of edges, and the weights their priors are centred on.
SAME, TAIL, NEAR, CHAIN = range(4)
EDGE_PRIOR = np.array([4.0, 4.0, 2.0, 0.2])
#: Pull of the weights towards zero, and of the edges' towards their priors.
DECAY = 3e-3
#: Shortest strings that one edit may tell apart.
NEAR_DIGITS, NEAR_NAME = 9, 5

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is entered at its start only: no match of these patterns can begin later in it.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9]){5,}(?![0-9A-Za-z])")
_HANDLE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]{2,64}@[^\x20\x09-\x0D@]{2,64}(?![^\x20\x09-\x0D])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _HOST.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in that order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Mention:
    start: int
    end: int
    keys: tuple[str, ...]
    base: int | None
    features: np.ndarray


def _features(s: str) -> np.ndarray:
    whole = any(a == 0 and b == len(s) for a, _, b in base_spans(s))
    d = "".join(c for c in s if c in "0123456789")
    n = len(d)
    return np.array(
        [
            1, "@" in s, n / 16, 9 <= n <= 11, 12 <= n <= 19, 12 <= n <= 19 and luhn(d), s.count(".") == 3 and n < 13, any(c in "()" for c in s),
            "-" in s, " " in s, s[:1] == "+", "." in s and n < 9, any(c.isalpha() for c in s), bool(_HOST.search(s)), not whole,
        ],
        float,
    )


def _keys(s: str, kind: int | None) -> tuple[str, ...]:
    """What a mention is recognised by: all its digits, or an address and its name."""
    if kind == 0 or "@" in s:
        name = s.partition("@")[0].lower()
        return ("a:" + s.lower(), "n:" + name) if len(name) >= 4 else ("a:" + s.lower(),)
    if any(c.isalpha() for c in s):
        return ("n:" + s.lower(),)
    d = "".join(c for c in s if c in "0123456789")
    return ("i:" + d,) if kind == 1 or s.count(".") == 3 and len(d) <= 12 else ("d:" + d,)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """Base spans, and beside them groups of six digits or more, handles, and words that are a base address's name."""
    out = [Mention(a, b, _keys(text[a:b], k), k, _features(text[a:b])) for a, k, b in base]
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or reach[k - 1] <= a

    found = [(m.start(), m.end()) for m in _NUMBER.finditer(text)]
    if "@" in text:
        found += [(m.start(), m.end()) for m in _HANDLE.finditer(text)]
    names = {k for m in out if m.base == 0 for k in m.keys if k.startswith("n:")}
    if names:
        for m in _WORD.finditer(text):
            word = m[0].strip(".,;:!?()[]<>\"'")
            if word and "n:" + word.lower() in names:
                a = m.start() + m[0].index(word)
                found.append((a, a + len(word)))
    end = 0
    for a, b in sorted(found):
        if a >= end and free(a, b):
            out.append(Mention(a, b, _keys(text[a:b], None), None, _features(text[a:b])))
            end = b
    return sorted(out, key=lambda m: (m.start, m.end))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def edges_of(nodes: list[Mention]) -> dict[tuple[int, int], int]:
    """Sort of each edge (i, j), i < j."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[str, int] = {}
    tail: dict[str, int] = {}
    holes: dict[str, list[str]] = defaultdict(list)
    for i, m in enumerate(nodes):
        for k in m.keys:
            if k in last:
                edges[last[k], i] = SAME
            else:
                body = k[2:]
                if k[0] == "d" and len(body) >= NEAR_DIGITS or k[0] == "n" and len(body) >= NEAR_NAME:
                    # Strings one edit apart are equal after at most one character of each is left out.
                    seen = set()
                    for v in {body, *(body[:c] + body[c + 1 :] for c in range(len(body)))}:
                        for other in holes[k[0] + v]:
                            if other not in seen and one_edit(body, other):
                                edges.setdefault((last[k[:2] + other], i), NEAR)
                            seen.add(other)
                        holes[k[0] + v] = [body]
            last[k] = i
            if k[0] == "d" and len(k) - 2 >= 10:
                t = k[-10:]
                if t in tail and edges.get((tail[t], i)) != SAME:
                    edges[tail[t], i] = TAIL
                tail[t] = i
        if i and 0 <= m.start - nodes[i - 1].end <= 1:
            edges.setdefault((i - 1, i), CHAIN)
    return edges


@dataclass
class Model:
    weights: np.ndarray  # label by feature
    edge: np.ndarray  # log odds that the ends of each sort of edge agree

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that message passing adds to the base spans."""
        nodes = mentions(text, base)
        if all(m.base is not None for m in nodes):
            return []
        labels = propagate(self.unary(nodes), {e: float(self.edge[k]) for e, k in edges_of(nodes).items()})
        return [(m.start, int(k), m.end) for m, k in zip(nodes, labels, strict=True) if m.base is None and k != OUTSIDE]

    def unary(self, nodes: list[Mention]) -> np.ndarray:
        out = np.stack([m.features for m in nodes]) @ self.weights.T
        for i, m in enumerate(nodes):
            if m.base is not None:
                out[i] = -60
                out[i, m.base] = 60
        return out


def linked(n: int, edges: list[tuple[int, int]], roots: list[int]) -> set[int]:
    """Nodes that edges join to a root."""
    near = defaultdict(list)
    for i, j in edges:
        near[i].append(j)
        near[j].append(i)
    found, todo = set(roots), list(roots)
    while todo:
        for j in near[todo.pop()]:
            if j not in found:
                found.add(j)
                todo.append(j)
    return found


def propagate(unary: np.ndarray, edges: dict[tuple[int, int], float]) -> np.ndarray:
    """Loopy sum-product with potentials exp(w) for agreeing labels; the most probable label of each node."""
    if not edges:
        return unary.argmax(1)
    pair = np.array(list(edges))
    src, dst = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
    w = np.tile(np.array(list(edges.values())), 2)[:, None]
    back = np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
    message = np.zeros((len(src), unary.shape[1]))
    for _ in range(MAX_ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, message)
        out = belief[src] - message[back]
        out -= out.max(1, keepdims=True)
        p = np.exp(out)
        new = np.log(p.sum(1, keepdims=True) + p * (np.exp(w) - 1))
        new -= new.mean(1, keepdims=True)
        moved, message = np.abs(new - message).max(), (new + message) / 2
        if moved < TOLERANCE:
            break
    belief = unary.copy()
    np.add.at(belief, dst, message)
    return belief.argmax(1)


def train(texts: list[str], seed: int = 0) -> Model:
    """Weights of nodes and edges together, by pseudo-likelihood (see above)."""
    rng = np.random.default_rng(seed)
    x, y, near = [], [], []
    for t in texts:
        nodes = mentions(t, base_spans(t))
        edges = edges_of(nodes)
        roots = [i for i, m in enumerate(nodes) if m.base is not None]
        hidden = linked(len(nodes), [e for e, k in edges.items() if k != CHAIN], roots) - set(roots)
        counts = np.zeros((len(nodes), len(EDGE_PRIOR), OUTSIDE + 1))
        label = [OUTSIDE if m.base is None else m.base for m in nodes]
        for (i, j), k in edges.items():
            counts[i, k, label[j]] += j not in hidden
            counts[j, k, label[i]] += i not in hidden
        for i, m in enumerate(nodes):
            if i not in hidden:
                x.append(m.features)
                y.append(label[i])
                near.append(counts[i])
    weights, edge = np.zeros((OUTSIDE + 1, len(_features("1")))), EDGE_PRIOR.copy()
    if x:
        x, y, near = np.array(x), np.array(y), np.array(near)
        blind = rng.random(len(x)) < 0.5
        x[blind, 1:] = 0
        target = np.eye(OUTSIDE + 1)[y]
        for _ in range(300):
            z = x @ weights.T + np.einsum("e,nek->nk", edge, near)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target) / len(x)
            weights -= 0.5 * (error.T @ x + DECAY * weights)
            edge -= 0.5 * (np.einsum("nk,nek->e", error, near) + DECAY * (edge - EDGE_PRIOR))
    return Model(weights, edge)


def fit(docs: DataFrame, rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """From up to ``rows`` documents with a digit or an @, drawn by a hash; of a longer text a part placed by a hash."""
    own = docs.where(F.col("text").rlike("[0-9@]"))
    # The draw's bound keeps what tasks send to about the rows asked for, however many tasks there are.
    n, steps = own.count(), 1 << 30
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))
    below = F.lit(min(steps, -(-3 * rows * steps // (2 * max(n, 1)))))
    start = (F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - chars, F.lit(1))) + 1).cast("int")
    got = own.where(draw < below).select(draw.alias("draw"), F.substring("text", start, F.lit(chars)).alias("t")).orderBy("draw", "t").limit(rows).collect()
    return train([r["t"] for r in got])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: Model, text: str = "text", redact: bool = False) -> DataFrame:
    """Every column of docs and base, spans (which replace columns so named): array<struct<start, end, kind>>. With ``redact`` the text has [KIND] for each span."""
    docs = docs.drop("base", "spans")
    kind = "array<struct<start:int,end:int,kind:string>>"
    schema = docs.withColumn("base", F.array().cast(kind)).withColumn("spans", F.array().cast(kind)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    any_mark = re.compile(r"[0-9@]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            table = pa.table(batch)
            texts = table.column(text).to_pylist()
            base, spans = [], []
            for t in texts:
                marked = bool(t) and any_mark.search(t)
                base.append(base_spans(t) if marked else [])
                spans.append(sorted(base[-1] + model.added(t, base[-1])) if marked else [])
            if redact:
                new = [hide(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                table = table.set_column(table.schema.get_field_index(text), text, pa.array(new, pa.string()))
            for name, got in (("base", base), ("spans", spans)):
                table = table.append_column(name, pa.array([[{"start": a, "end": e, "kind": KINDS[k]} for a, k, e in g] for g in got], arrow))
            yield from table.to_batches()

    return docs.mapInArrow(run, schema)


def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans go as one, under the kind of the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
