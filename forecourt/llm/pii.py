"""Personal data by patterns, and by a skip-chain conditional random field that adds spans.

Tokens with a digit or an at sign are the nodes; any other token can only be `none`. Tokens under a
span of the patterns are observed. Neighbours in the text share an edge, and so does each token
with the next one that has the same core or the same digits, however far away. Loopy belief
propagation over both kinds of edges gives each free token its label, so a number found once in a
full form is also found where it is repeated in a form that no pattern takes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm import arrays as A
from forecourt.llm.sampling import bounded_sample

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)

# The patterns of the four kinds. The look-behind and the possessive parts only
# keep the search from starting or backing up inside a run of digits, where it can't succeed.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MARK = re.compile(r"[0-9@]\S*")
EDGE = re.compile(r"^[^\w+]+|\W+$")
NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; the name before an at sign is the run of its characters after the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of what the patterns find, in order."""
    found = [(s, e, 0) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, core) of the tokens with a digit or an at sign; the core has no marks at its ends."""
    out, done = [], 0
    for m in MARK.finditer(text):
        start, end = m.span()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end
        token = text[start:end]
        core = EDGE.sub("", token)
        if core:
            start += token.index(core)
            out.append((start, start + len(core), core))
    return out


FEATURES = 15


def _features(core: str) -> tuple[float, ...]:
    n = sum(map(str.isdigit, core))
    dots, dashes = core.count("."), core.count("-")
    return (
        1.0, "@" in core, "@" in core and "." in core, dots == 3 and n >= 4, dots > 0, dashes == 1, dashes > 1,
        n / max(1, len(core)), n >= 4, n >= 7, n >= 10, n >= 14,
        n < 3, "@" not in core and any(map(str.isalpha, core)), core[0] == "+",
    )


def _keys(core: str) -> list[str]:
    """What makes two tokens the same or similar."""
    keys = ["=" + core.casefold()] if len(core) >= 4 else []
    digits = NOT_DIGIT.sub("", core)
    if len(digits) >= 7:
        keys.append("#" + digits)
    if "@" in core:
        name = core.split("@")[0].casefold()
        if len(name) >= 4:
            keys.append("=" + name)
    return keys


@dataclass(frozen=True)
class PiiModel:
    weights: np.ndarray  # (features, labels)
    near: np.ndarray  # log potential of labels of neighbouring tokens
    far: np.ndarray  # log potential of labels of equal or similar tokens
    rounds: int
    least: float


@dataclass(frozen=True)
class PiiRules:
    sample_rows: int = 2000  # rows the potentials are fitted on, at most
    sample_chars: int = 20_000
    rounds: int = 12  # of message passing
    least: float = 0.5  # probability from which a span is added
    epochs: int = 400
    neighbours: int = 3  # characters between tokens that share a near edge, at most


class _Graph:
    """Nodes and edges of many texts at once."""

    def __init__(self, texts: list[str], neighbours: int):
        self.base, self.nodes, self.owner, self.seen = [], [], [], []
        near, far = [], []
        for row, text in enumerate(texts):
            spans = base_spans(text) if text else []
            self.base.append(spans)
            first, last = len(self.nodes), {}
            at = 0
            for start, end, core in _tokens(text) if text else ():
                while at < len(spans) and spans[at][1] <= start:
                    at += 1
                label = next((k for s, e, k in spans[at : at + 4] if s < end and e > start), -1)
                me = len(self.nodes)
                if me > first and start - self.nodes[-1][1] <= neighbours:
                    near.append((me - 1, me))
                for key in _keys(core):
                    if key in last:
                        far.append((last[key], me))
                    last[key] = me
                self.nodes.append((start, end, core))
                self.owner.append(row)
                self.seen.append(label)
        self.near = np.array(near, np.int64).reshape(-1, 2)
        self.far = np.unique(np.array(far, np.int64).reshape(-1, 2), axis=0)
        self.far = self.far[self.far[:, 0] != self.far[:, 1]]

    def features(self) -> np.ndarray:
        return np.array([_features(c) for _, _, c in self.nodes], np.float64).reshape(-1, FEATURES)


def train_pii_model(docs: DataFrame, rules: PiiRules = PiiRules()) -> PiiModel:
    """Potentials from a bounded sample in which the patterns label the tokens.

    Node weights come from a softmax by gradient descent, edge potentials from how often labels
    meet over an edge, against chance. An empty sample gives potentials that add nothing.
    """
    labels = NONE + 1
    rows = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]")), ["doc_id", "text"], rules.sample_rows, rules.sample_chars)
    graph = _Graph([r["text"] for r in rows], rules.neighbours)
    if not graph.nodes:
        return PiiModel(np.zeros((FEATURES, labels)), np.zeros((labels, labels)), np.zeros((labels, labels)), rules.rounds, 2.0)
    seen = np.array(graph.seen)
    seen[seen < 0] = NONE
    x, y = graph.features(), np.eye(labels)[seen]
    weights = np.zeros((FEATURES, labels))
    for step in range(rules.epochs):
        z = x @ weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        weights -= (2.0 / (1 + step / 200)) * (x.T @ (z - y) / len(x) + 1e-4 * weights)
    share = (y.sum(axis=0) + 1) / (len(y) + labels)

    def potential(edges: np.ndarray, prior: float) -> np.ndarray:
        meet = np.outer(share, share) * prior
        np.add.at(meet, (seen[edges[:, 0]], seen[edges[:, 1]]), 1)
        meet = (meet + meet.T) / 2
        return np.log(meet / meet.sum() / np.outer(share, share))

    near = np.clip(potential(graph.near, 50.0), -3, 3)
    # Equal tokens carry the same label unless told otherwise: a firm start that counts can soften.
    far = np.clip(potential(graph.far, 10.0), -2, 2) + 6 * np.eye(labels)
    far[NONE] -= 3
    far[:, NONE] -= 3
    return PiiModel(weights, near, far, rules.rounds, rules.least)


def _beliefs(graph: _Graph, model: PiiModel) -> np.ndarray:
    """Label probabilities of all nodes after loopy sum-product message passing."""
    n, labels = len(graph.nodes), NONE + 1
    own = graph.features() @ model.weights
    own -= own.max(axis=1, keepdims=True)
    seen = np.array(graph.seen)
    fixed = seen >= 0
    own[fixed] = -60.0
    own[np.flatnonzero(fixed), seen[fixed]] = 0.0
    pairs = np.concatenate([graph.near, graph.far])
    tables = np.concatenate([np.broadcast_to(model.near, (len(graph.near), labels, labels)), np.broadcast_to(model.far, (len(graph.far), labels, labels))])
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    messages = np.zeros((len(source), labels))
    for _ in range(model.rounds if len(source) else 0):
        total = own.copy()
        np.add.at(total, target, messages)
        out = (total[source] - messages[back])[:, :, None] + tables
        top = out.max(axis=1, keepdims=True)
        sent = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        sent -= sent.max(axis=1, keepdims=True)
        step = 0.5 * messages + 0.5 * sent
        moved = np.abs(step - messages).max()
        messages = step
        if moved < 1e-4:
            break
    total = own.copy()
    np.add.at(total, target, messages)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def find_pii(texts: list[str | None], model: PiiModel, neighbours: int = 3) -> list[tuple[list, list]]:
    """Per text its base spans and all spans, both sorted by start, then kind."""
    graph = _Graph([t or "" for t in texts], neighbours)
    added: list[list] = [[] for _ in texts]
    if graph.nodes:
        chance = _beliefs(graph, model)
        label = chance[:, :NONE].argmax(axis=1)
        sure = (chance[np.arange(len(label)), label] >= model.least) & (np.array(graph.seen) < 0)
        for i in np.flatnonzero(sure).tolist():
            start, end, _ = graph.nodes[i]
            added[graph.owner[i]].append((start, end, int(label[i])))
    out = []
    for base, more in zip(graph.base, added, strict=True):
        out.append((base, sorted(base + more, key=lambda s: (s[0], s[2], s[1]))))
    return out


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def detect_pii(docs: DataFrame, model: PiiModel, rules: PiiRules = PiiRules()) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_spans and spans.

    Spans are written kind:start:end, in code points with an exclusive end, by start, then kind,
    joined by commas. `spans` holds those of the patterns and those that the field adds. Null and
    empty texts have none. Rows are independent, so repeated rows give repeated results.
    """
    texts = A.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"]

    def run(batches):
        for piece in A.pieces(batches, "text", 1 << 20):
            found = find_pii(piece.column("text").to_pylist(), model, rules.neighbours)
            counts = [[sum(k == kind for _, _, k in base) for base, _ in found] for kind in range(NONE)]
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([_written(base) for base, _ in found], pa.string()),
                    pa.array([_written(spans) for _, spans in found], pa.string()),
                ],
                names,
            )

    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")
