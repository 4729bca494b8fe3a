"""The licence of a whole text: its best span against the licence texts, and its SPDX line.

Every template (a one-line notice, a standard header or a whole licence) is compared with the
spans of its own length in words, so line breaks, comment marks and text around a notice do
not matter. Weights are TF-IDF with document frequencies over the templates, which are fixed;
a word that no template holds has the greatest idf.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import numpy as np

TERM = re.compile("[a-z0-9]+")
#: What a text with any notice contains; no template and no SPDX line fails it.
KEYWORD = r"licen[sc]e|copyright|all\W+rights\W+reserved"
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(?[\w.+-]+\)?(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[\w.+-]+\)?)*)", re.I)
#: Least cosines of spans of at most SHORT words, and of longer ones.
SHORT, LEAST_SHORT, LEAST = 20, 0.8, 0.85
#: Longer spans move by this part of their length.
STEP = 16
LAST = "Proprietary"


def licence_texts() -> list[tuple[str, str]]:
    """(licence, text) of the standard headers and whole licences."""
    folder = Path(__file__).parent / "license_texts"
    return [(re.sub(r"\.(header2?|title)$", "", p.stem), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


def rank(name: str, cosine: float) -> tuple:
    """Least first: any licence before "all rights reserved", then by cosine, then by name."""
    return (name == LAST, -cosine, name)


class Matcher:
    """templates: (licence, text); holds arrays only, so that it can be sent to workers."""

    def __init__(self, templates: list[tuple[str, str]]):
        bags = [(name, TERM.findall(text.lower())) for name, text in templates]
        df = Counter(w for _, ws in bags for w in set(ws))
        self.ids = {w: i for i, w in enumerate(sorted(df))}
        idf = lambda n: np.log((1 + len(bags)) / (1 + n)) + 1
        self.idf, self.other = np.array([idf(df[w]) for w in self.ids]), float(idf(0))
        self.goals = []
        for name, ws in bags:
            v = np.bincount([self.ids[w] for w in ws], minlength=len(self.ids)) * self.idf
            self.goals.append((name, len(ws), (v / np.sqrt(v @ v)).astype(np.float64)))

    def best(self, text: str | None) -> tuple[str, float] | None:
        """(licence, cosine) of the best span, an SPDX line counting 1; None below the bounds."""
        if not text:
            return None
        found = [(m.group(1), 1.0) for m in SPDX.finditer(text)]
        found = [(re.sub(r"-(only|or-later)$|\+$", "", s.strip("()")) if " " not in s else s, c) for s, c in found]
        own = {}
        at = np.array([self.ids[w] if w in self.ids else own.setdefault(w, len(self.ids) + len(own)) for w in TERM.findall(text.lower())], np.int64)
        if len(at):
            idf = np.concatenate([self.idf, np.full(len(own), self.other)])
            # the cosine of a span is the sum of its words' parts over a norm that is at least this root
            low = np.concatenate([[0.0], np.cumsum(idf[at] ** 2)])
            found += [(name, c) for name, n, v in self.goals if (c := self._span(at, idf, low, n, v))]
        return min(found, key=lambda x: rank(*x), default=None)

    def _span(self, at, idf, low, n, v) -> float:
        known = at < len(v)
        part = np.zeros(len(at))
        part[known] = v[at[known]] * idf[at[known]]
        total = np.concatenate([[0.0], np.cumsum(part)])
        n = min(n, len(at))
        least, step = (LEAST_SHORT, 1) if n <= SHORT else (LEAST, max(1, n // STEP))
        starts = np.arange(0, len(at) - n + 1, step)
        if starts[-1] != len(at) - n:
            starts = np.append(starts, len(at) - n)
        dot = total[starts + n] - total[starts]
        bound = dot / np.sqrt(low[starts + n] - low[starts])
        best = 0.0
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < max(best, least) - 1e-9:
                break
            words, tf = np.unique(at[starts[k] : starts[k] + n], return_counts=True)
            best = max(best, float(dot[k] / np.sqrt(((idf[words] * tf) ** 2).sum())))
        best = round(best, 6)
        return best if best >= least else 0.0
