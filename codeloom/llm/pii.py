"""Personal information inside free text: candidate spans, boosted trees, calibrated thresholds.

Generators propose overlapping spans with high recall. Boosted trees judge each span by its format and context. They are
fitted on texts of one generator; on texts of another, held out, their scores are calibrated and per kind the threshold
is taken that serves recall and precision best there. Of overlapping spans the likeliest counts. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from codeloom.llm.boost import Boosted
from codeloom.llm.pii_candidates import KINDS, N_FEATURES, candidates, features
from codeloom.llm.pii_training import Composer, Maker
from codeloom.session import spread

N_TRAIN, N_HELD, SEED = 6000, 4000, 11
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}


def labelled(maker: Maker, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates of n generated texts."""
    xs, ys = [], []
    for _ in range(n):
        text, spans = maker.text()
        truth = set(spans)
        for kind, pattern, a, b in candidates(text):
            xs.append(features(text, kind, pattern, a, b))
            ys.append((kind, a) in truth)
    return np.array(xs, np.float32).reshape(-1, N_FEATURES), np.array(ys, bool)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the greatest F1, in the middle between the last score taken and the first one left."""
    order = np.argsort(-p, kind="stable")
    s, hit = p[order], np.cumsum(y[order])
    last = np.append(s[1:] < s[:-1], True)  # equal scores go together
    f1 = np.where(last, 2 * hit / (np.arange(1, len(s) + 1) + max(1, y.sum())), -1.0)
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


@lru_cache(maxsize=2)
def train(n: int = N_TRAIN, seed: int = SEED) -> tuple[Boosted, dict[str, float]]:
    """Trees fitted on n composed texts, calibrated on N_HELD sentences of another generator; both bounded samples."""
    x, y = labelled(Composer(seed), n)
    xh, yh = labelled(Maker(seed + 1), N_HELD)
    model = Boosted().fit(x, y, xh, yh)
    p, kind = model.predict(xh), xh[:, 0].astype(int)
    return model, {name: best_cut(p[kind == k], yh[kind == k]) if (kind == k).any() else 0.5 for k, name in enumerate(KINDS)}


def find_spans(texts: list[str], model: Boosted, cut: dict[str, float]) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, probability) of the items of each text, in order, without overlaps."""
    spans, xs, owner = [], [], []
    for i, t in enumerate(texts):
        for kind, pattern, a, b in candidates(t or ""):
            spans.append((kind, a, b))
            xs.append(features(t, kind, pattern, a, b))
            owner.append(i)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not spans:
        return out
    p = model.predict(np.array(xs, np.float32))
    by: dict[int, list[tuple[float, int]]] = {}
    for j, (i, (kind, _, _)) in enumerate(zip(owner, spans)):
        if p[j] >= cut[kind]:
            by.setdefault(i, []).append((float(p[j]), j))
    for i, found in by.items():
        taken: list[tuple[int, int]] = []
        # the likeliest first, to two digits; then the longer, the earlier
        for q, j in sorted(found, key=lambda x: (-round(x[0], 2), spans[x[1]][1] - spans[x[1]][2], spans[x[1]][1])):
            kind, a, b = spans[j]
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                out[i].append((kind, a, b, q))
        out[i].sort(key=lambda s: s[1])
    return out


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with a typed placeholder instead of each item."""
    parts, at = [], 0
    for kind, a, b, _ in spans:
        parts += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*parts, text[at:]])


def _finder(model: Boosted, cut: dict[str, float], key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            rows = [(k, kind, a, b, q) for k, found in zip(pdf[key], find_spans(texts, model, cut)) for kind, a, b, q in found]
            yield pd.DataFrame(rows, columns=[key, "kind", "start_pos", "end_pos", "probability"]).astype({"start_pos": "int32", "end_pos": "int32", "probability": "float64"})

    return run


def _redactor(model: Boosted, cut: dict[str, float], key: str, text: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf[text]]
            found = find_spans([t or "" for t in texts], model, cut)
            yield pd.DataFrame({key: pdf[key], "redacted": [None if t is None else redact(t, s) for t, s in zip(texts, found)], "n_items": np.array([len(s) for s in found], "int32")})

    return run


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", n_train: int = N_TRAIN) -> DataFrame:
    """``key, kind, start_pos, end_pos, probability``: one row an item; positions count characters from 0.

    Null and empty texts have no items; repeated rows come out once each; further columns are ignored.
    """
    model, cut = train(n_train)
    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text)).mapInPandas(_finder(model, cut, key, text), f"{key} {kind}, kind string, start_pos int, end_pos int, probability double")


def redact_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", n_train: int = N_TRAIN) -> DataFrame:
    """``key, redacted, n_items``: every text with typed placeholders; a null text stays null."""
    model, cut = train(n_train)
    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text)).mapInPandas(_redactor(model, cut, key, text), f"{key} {kind}, redacted string, n_items int")
