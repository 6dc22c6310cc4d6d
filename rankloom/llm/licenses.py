"""Licences in texts: ordered signature rules behind keyword gates, overlaps resolved by priority and containment.

Rules run on the lower-cased UTF-8 bytes of whole texts.  A rule is tried only if one of its keywords occurs in
the text with its white space made single spaces; most texts fail the first gate and cost a few searches.  Of the detections, those contained in one of higher priority (or of the same
priority and not shorter) are suppressed.  The three base phrases are outside of that: all their places count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .license_rules import MACROS, RULES
from .rows import append
from .text import ALNUM, buffers, chunks, word_spans

_W = rb"0-9a-z\x80-\xff"
_GAP = rb"[^" + _W + rb"]+"

#: Fixed phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The score of a detection by its rule's priority.
SCORES = (1.0, 0.95, 0.9, 0.7, 0.4)
#: No rule can match a text that has none of these; parts of single words, as white space may be anything.
GATE = tuple(
    w.encode("latin-1")
    for w in (
        "licen copyright (c) &copy; \xc2\xa9 domain warrant permission redistribution provided prohibited confidential reproduced portions consortium endorse advertising "
        "misrepresented attribution invariant classpath itself jpeg mozilla apache openssl creative cc bsd gpl mpl asl al2 cddl gfdl cecill unencumbered fuck wtfpl rail as-is"
    ).split(" ")
)


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All signature rules in order, compiled."""
    out = []
    for label, priority, keywords, pattern, _ in RULES:
        for name, value in MACROS.items():
            pattern = pattern.replace(name, value)
        pattern = pattern.replace("[ -]", r"(?:\s+|-)").replace(" ", r"\s+").replace("~", r"\s*")
        out.append(Rule(label, priority, SCORES[priority], tuple(keywords.encode("latin-1").split(b"|")), re.compile(f"(?<![0-9a-z])(?:{pattern})(?![0-9a-z])".encode("latin-1"))))
    return out


def suppress(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (priority, start, end, rule) those that no better one contains: lower priority number, then longer, then earlier."""
    kept, starts, ends = [], [], []  # starts and ends: the maximal intervals so far, both ascending
    for d in sorted(found, key=lambda d: (d[0], d[1] - d[2], d[1], d[3])):
        i = bisect_right(starts, d[1])
        if i and ends[i - 1] >= d[2]:
            continue
        kept.append(d)
        j = i - (i > 0 and starts[i - 1] == d[1])
        k = j
        while k < len(ends) and ends[k] <= d[2]:
            k += 1
        starts[j:k], ends[j:k] = [d[1]], [d[2]]
    return sorted(kept, key=lambda d: d[1:])


_PHRASES = [(label, re.compile(_GAP.join(w.encode() for w in phrase.split()) + rb"(?![" + _W + rb"])")) for phrase, label in BASE]
_FIRST = [phrase.split()[0].encode() for phrase, _ in BASE]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one row per row.

    detections: array<struct(label, start, end, score)>, code points with exclusive ends, what suppression leaves.
    score is the best one of a detection; 0.9 for a base phrase alone, 0 for none.  A null or empty text has no words,
    empty labels and null first_word and last_word; ids may be null or repeated; other columns are ignored.
    """

    def scan(b: pa.RecordBatch, all_rules: list[Rule]) -> list:
        offs, data = buffers(b.column(1))
        out = [[] for _ in range(8)]
        for lo, hi in chunks(offs):
            part = offs[lo : hi + 1] - offs[lo]
            low, starts, _, at = word_spans(part, data[offs[lo] : offs[hi]], ALNUM)
            whole = low.tobytes()
            for i in range(hi - lo):
                text = whole[part[i] : part[i + 1]]
                places, labels, found = [], set(), []
                for (label, pattern), first in zip(_PHRASES, _FIRST):
                    if first in text:
                        for m in pattern.finditer(text):
                            p = m.start()
                            if not p or not ALNUM[text[p - 1]]:
                                places.append(int(np.searchsorted(starts, part[i] + p)) - int(at[i]))
                                labels.add(label)
                if any(g in text for g in GATE):
                    flat = b" ".join(text.split())
                    gates: dict[tuple[bytes, ...], bool] = {}
                    for k, r in enumerate(all_rules):
                        if r.keywords not in gates:
                            gates[r.keywords] = any(w in flat for w in r.keywords)
                        if gates[r.keywords]:
                            found += [(r.priority, m.start(), m.end(), k) for m in r.pattern.finditer(text)]
                    found = suppress(found)
                cp = lambda n: len(text[:n].decode("utf-8", "ignore"))
                spans = [{"label": all_rules[k].label, "start": cp(a), "end": cp(e), "score": all_rules[k].score} for _, a, e, k in found]
                for col, x in zip(out, (int(at[i + 1] - at[i]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s["label"] for s in spans})), max([s["score"] for s in spans] + [0.9] * bool(labels), default=0.0), spans)):
                    col.append(x)
        return out

    return append(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,score:double>>",
        scan, rules, ["doc_id"],
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


QUERIES = {"op2_license_scan": op2_license_scan}
