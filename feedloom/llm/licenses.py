"""Licence scan: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Scored are every line, every run of as many terms as a template has, across lines too, and the file
as a whole, so that other words on the line or a line break within the wording do not hide a
licence. Any of them can only reach the threshold if it holds one of the anchors: the heaviest terms
of each template, chosen so that all its other terms together stay below the threshold
(Cauchy-Schwarz). So files without an anchor are known to match nothing. The others are read twice. The first reading finds the
passages that reach the threshold by template terms alone, and gives the other terms that they hold, never
passages; those terms are counted over all files. The second reading scores the same passages in full. Which starts of a
run may reach the threshold follows from the terms that the run holds, summed over all starts at once. A passage that its sentence
denies ("not released under ...", "released under ... before"), or that states another version than the template's, does not count. A line ``SPDX-License-Identifier: ...`` is taken as it says.
Inheritance works on distinct directories: each is joined, by equality, with its ancestors.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, join_by_key, small, written
from .license_texts import TEMPLATES

THRESHOLD = 0.55
TERM = r"[a-z0-9]+"
#: Terms that deny what follows in the sentence, if at most REACH terms before it.
DENIALS, REACH = {"not", "no", "never", "neither", "nor", "without", "cannot", "isn", "aren", "wasn", "weren"}, 4
#: Terms that deny what stands at most REACH terms before them in the sentence.
BYGONE = {"before", "formerly", "previously", "anymore"}
#: Counted terms that are sent to every task at most; beyond that they are joined to the files.
BROADCAST_TERMS = 200_000
SPDX = r"(?im)^[^\w\n]*SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)"
_TOKEN = re.compile(rf"({TERM})|[.;!?](?=\s|$)")


def damped(n: int) -> float:
    """The weight of a term that occurs n times, before its inverse document frequency."""
    return 1 + math.log(n) if n > 0 else 0.0


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def stated_versions(words: list[str]) -> list[tuple[int, str]]:
    """Where a version is stated, and its first number: of ``version 3``, also ``v3``, the 3."""
    found = [(k, words[k + 1]) for k, t in enumerate(words[:-1]) if t == "version" and words[k + 1].isdigit()]
    return sorted(found + [(k, t[1:]) for k, t in enumerate(words) if t[0] == "v" and t[1:].isdigit()])


class Matcher:
    """Template vectors under given inverse document frequencies."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], files: int, threshold: float):
        self.idf = {t: math.log((files + 1) / (frequency.get(t, 0) + 1)) + 0.05 for _, text in templates for t in terms(text)}
        self.files = files
        self.names = [name for name, _ in templates]
        self.threshold = threshold
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        #: The weights, number of terms and anchors of each template.
        self.wording: list[tuple[dict[str, float], int, set[str]]] = []
        for i, (_, text) in enumerate(templates):
            weight = {t: damped(n) * self.idf[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            rest, own = 1.0, set()
            for t, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
                if rest >= (threshold - 1e-9) ** 2:
                    own.add(t)
                rest -= (w / norm) ** 2
                self.by_term.setdefault(t, []).append((i, w / norm))
            self.wording.append(({t: w / norm for t, w in weight.items()}, len(terms(text)), own))
        #: Denying terms that each template holds itself, and the versions it states.
        self.denials = [sum(t in DENIALS for t in terms(text)) for _, text in templates]
        self.bygone = [sum(t in BYGONE for t in terms(text)) for _, text in templates]
        self.versions = [{v for _, v in stated_versions(terms(text))} for _, text in templates]
        #: The number of each template term, and the square of each one's weight in each template.
        self.numbers = {t: k for k, t in enumerate(self.idf)}
        self.squares = np.zeros((len(templates), len(self.numbers) + 1))
        for i, (weight, _, _) in enumerate(self.wording):
            for t, w in weight.items():
                self.squares[i, self.numbers[t]] = w * w
        self.anchors = sorted(set().union(*[own for _, _, own in self.wording]))

    def _starts(self, words: np.ndarray, i: int) -> np.ndarray:
        """Starts of the runs of template i's length that hold enough of its terms: a passage is no closer than the terms it holds allow.

        ``words`` has the number of each word in ``self.numbers`` (-1 for others). A term counts once for each run that holds it: for
        those that hold an occurrence and not the one before.
        """
        size = self.wording[i][1]
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        value = self.squares[i][words]  # the last entry, of other words, is 0
        at = np.flatnonzero(value)
        order = np.lexsort((at, words[at]))
        at = at[order]
        before = np.where(np.diff(words[at], prepend=-2) == 0, np.concatenate([[-1], at[:-1]]), -1)
        low, high = np.maximum(before + 1, np.maximum(at - size + 1, 0)), np.minimum(at, n - 1)
        ok = low <= high
        change = np.bincount(low[ok], value[at[ok]], n + 1) - np.bincount(high[ok] + 1, value[at[ok]], n + 1)
        return np.flatnonzero(np.cumsum(change)[:n] >= (self.threshold - 1e-9) ** 2 - 1e-9)

    def _runs(self, words: list[str], numbers: np.ndarray, i: int, counts: dict[str, int] | None) -> Iterator[tuple[int, float, bool]]:
        """Start, cosine and whether there are only template terms, of the runs of template i that may match; without ``counts``, by template terms alone."""
        weights, size, _ = self.wording[i]
        held: Counter = Counter()
        dot = square = 0.0
        at, others = -size - 1, 0

        def count(t: str, by: int) -> None:
            nonlocal dot, square, others
            w = self.idf.get(t)
            if w is None:
                others += by
                if counts is None:
                    return
                w = self.other_idf(counts.get(t, 0))
            old, new = damped(held[t]), damped(held[t] + by)
            held[t] += by
            square += (new * new - old * old) * w * w
            dot += (new - old) * w * weights.get(t, 0.0)

        for start in self._starts(numbers, i).tolist():
            if start - at < size:
                for k in range(at, start):
                    count(words[k], -1)
                    count(words[k + size], 1)
            else:
                held.clear()
                dot, square, others = 0.0, 0.0, 0
                for t in words[start : start + size]:
                    count(t, 1)
            at = start
            yield start, dot / math.sqrt(max(square, 1e-300)), not others

    def other_idf(self, n: int) -> float:
        """The inverse document frequency of a term of no template that n files hold."""
        return math.log((self.files + 1) / (n + 1)) + 0.05

    def _within_reach(self, held: set[str]) -> list[int]:
        """Templates of which a passage with these terms may reach the threshold: the square of a cosine is at most the weight of the terms held."""
        mass: dict[int, float] = {}
        for t in held:
            for i, v in self.by_term.get(t, ()):
                mass[i] = mass.get(i, 0.0) + v * v
        return sorted(i for i, m in mass.items() if m >= (self.threshold - 1e-9) ** 2)

    def _share(self, n: Counter, allowed: list[int], counts: dict[str, int] | None) -> tuple[float, int]:
        """The highest cosine of term counts to one of the templates, and which (the first of equals); without ``counts`` by template terms alone."""
        dot: dict[int, float] = {}
        square = 0.0
        for t, c in n.items():
            if t in self.idf:
                w = damped(c) * self.idf[t]
                for i, v in self.by_term[t]:
                    dot[i] = dot.get(i, 0.0) + w * v
            elif counts is not None:
                w = damped(c) * self.other_idf(counts.get(t, 0))
            else:
                continue
            square += w * w
        norm = math.sqrt(max(square, 1e-300))
        return max(((dot[i] / norm, -i) for i in allowed if i in dot), key=lambda x: (round(x[0], 12), x[1]), default=(0.0, 0))

    def passages(self, text: str, counts: dict[str, int] | None = None) -> tuple[list[str], list[tuple[int, int, int, float]], tuple[int, int, int, float] | None]:
        """The words of a file; (start, end, template, cosine) of its passages that may match, runs, lines and the whole (start -1), in order of start; and the longest whole template. Where there are whole templates nothing is closer, and they alone are given.

        Without ``counts`` (files that hold each term of
        no template) cosines are by template terms alone, so none is lower than with them, and the same passages come out.
        """
        reach = self._within_reach(set(terms(text)))
        if not reach:
            return [], [], None
        words, sentence, line_ends = [], [], []
        sentences = 0
        for line in text.lower().splitlines():
            for m in _TOKEN.finditer(line):
                if m[1]:
                    words.append(m[1])
                    sentence.append(sentences)
                else:
                    sentences += 1
            line_ends.append(len(words))
        denials = np.cumsum([0, *[t in DENIALS for t in words]])
        numbers = np.array([self.numbers.get(t, -1) for t in words], np.int64)
        stated = stated_versions(words)
        places = [k for k, _ in stated]
        floor = self.threshold - 1e-9

        bygone = np.cumsum([0, *[t in BYGONE for t in words]])

        def denied(start: int, end: int, own: int, own_bygone: int | None) -> bool:
            before, after = start, end
            while before > 0 and start - before < REACH and sentence[before - 1] == sentence[start]:
                before -= 1
            while after < len(words) and after - end < REACH and sentence[after] == sentence[end - 1]:
                after += 1
            return denials[start] > denials[before] or denials[end] - denials[start] > own or (own_bygone is not None and bygone[after] - bygone[start] > own_bygone)

        def other_version(i: int, start: int, end: int) -> bool:
            if not self.versions[i]:
                return False
            said = {v for _, v in stated[bisect_left(places, start) : bisect_left(places, end + 2)]}
            return bool(said) and not said & self.versions[i]

        found: list[tuple[int, int, int, float]] = []
        closed_ones: list[tuple[int, int, int, float]] = []
        shares = {} if counts is None else {x[:3]: True for x in self.passages(text)[1]}
        for i in reach:
            size, allowed = self.wording[i][1], self.denials[i]
            for start, share, closed in self._runs(words, numbers, i, counts):
                if counts is not None and (start, start + size, i) not in shares:
                    continue
                if counts is not None or (share >= floor and not denied(start, start + size, allowed, self.bygone[i]) and not other_version(i, start, start + size)):
                    (closed_ones if closed and share > 1 - 1e-9 else found).append((start, start + size, i, share))
        if closed_ones:
            return words, sorted(closed_ones), min(closed_ones, key=lambda x: (x[0] - x[1], x[0]))
        at, known, most = 0, dict.fromkeys(self.anchors), max(self.denials)
        ends = [*line_ends, len(words)]
        for k, end in enumerate(ends):
            at = 0 if k == len(line_ends) else at
            line = words[at:end]
            if (any(t in known for t in line) if k < len(line_ends) else len(words) >= 30) and not (k < len(line_ends) and denied(at, end, *((0, 0) if len(line) < 30 else (most, None)))):
                n = Counter(line)
                free = [i for i in self._within_reach(set(n)) if not other_version(i, at, end)]
                if free and self._share(n, free, None)[0] >= floor:
                    score, i = self._share(n, free, counts)
                    found.append((at if k < len(line_ends) else -1, end, -i, score))
            at = end
        return words, sorted(found, key=lambda x: x[0]), None

    def wanted(self, text: str) -> list[str] | None:
        """The terms of no template that a file's passages hold; None where there are no passages."""
        words, found, _ = self.passages(text)
        if not found:
            return None
        spans = np.zeros(len(words) + 1, np.int64)
        for start, end, _, _ in found:
            spans[max(start, 0)] += 1
            spans[end] -= 1
        return list(dict.fromkeys(words[k] for k in np.flatnonzero(np.cumsum(spans)) if words[k] not in self.idf))

    def judged(self, text: str, counts: dict[str, int]) -> tuple[str, float, list[str]] | None:
        """The closest template of any passage of a file, its cosine, and the names of all templates met, each by passages that no closer one overlaps; ties go to the first passage."""
        words, found, best = self.passages(text, counts)
        for x in found if best is None else []:
            if x[3] >= self.threshold and (best is None or x[3] > best[3] + 1e-12):
                best = x
        if best is None:
            return None
        covered, names = np.zeros(len(words), bool), {}
        for start, end, i, score in sorted(found, key=lambda x: (-round(x[3], 9), x[0])):
            if score >= self.threshold and start >= 0 and not covered[start:end].any():
                covered[start:end] = True
                names[self.names[i]] = min(names.get(self.names[i], start), start)
        names = names or {self.names[best[2]]: 0}
        return self.names[best[2]], min(1.0, best[3]), sorted(names, key=lambda n: (names[n], n))

    def best(self, line: str, frequency: dict[str, int] | None = None, only: int | None = None) -> tuple[str, float] | None:
        """The closest template (or ``only`` that one) of one passage at or above the threshold; ties go to the first template.

        ``frequency`` has the number of files that hold each term of no template; no file is taken to hold others.
        """
        found = Counter(terms(line))
        if not any(t in found for t in self.anchors):
            return None
        dot: dict[int, float] = {}
        norm = 0.0
        for t, n in found.items():
            w = damped(n) * (self.idf[t] if t in self.idf else math.log((self.files + 1) / ((frequency or {}).get(t, 0) + 1)) + 0.05)
            norm += w * w
            for i, v in self.by_term.get(t, ()):
                if only is None or i == only:
                    dot[i] = dot.get(i, 0.0) + w * v
        if not dot:
            return None
        i, score = max(dot.items(), key=lambda x: (round(x[1] / math.sqrt(norm), 12), -x[0]))
        score = min(1.0, score / math.sqrt(norm))
        return (self.names[i], score) if score >= self.threshold else None


def _distinct_terms() -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"))


def _constant(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def matcher(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> Matcher:
    """Count the template terms over all files (text) and build the template vectors. Null texts count as empty files."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    held = F.array_intersect(_distinct_terms(), F.array(*map(F.lit, vocabulary)))
    rows = files.select(F.explode(F.array_append(held, F.lit(""))).alias("term")).groupBy("term").count().collect()
    frequency = {r["term"]: r["count"] for r in rows}
    return Matcher(templates, frequency, frequency.pop("", 0), threshold)


def scan(files: DataFrame, model: Matcher) -> DataFrame:
    """Adds own_license, own_score (null where nothing matches) and own_licenses (all that are met, in order) to files with a text column.

    Terms of no template are counted where a passage that may match holds them. Up to ``BROADCAST_TERMS`` of them are sent to
    the second reading; beyond that each file is joined with its own. No more than a file's distinct terms are ever made of it.
    """
    held = files.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def wanted(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.wanted(t) if t is not None else None for t in texts], dtype=object)

    kind = "own_license string, own_score double, own_licenses array<string>"

    def judged(texts: pd.Series, known: Iterator[dict[str, int]]) -> pd.DataFrame:
        found = [(held.value.judged(t, k) if t is not None else None) or (None, None, None) for t, k in zip(texts, known, strict=False)]
        return pd.DataFrame({"own_license": pd.Series([x[0] for x in found], dtype=object), "own_score": pd.Series([x[1] for x in found], dtype="Float64"), "own_licenses": pd.Series([x[2] for x in found], dtype=object)})

    named = F.lower("text").contains("spdx-license-identifier:")
    files = files.drop("own_license", "own_score", "own_licenses").withColumn("_spdx", F.when(named, F.nullif(F.regexp_extract("text", SPDX, 1), F.lit(""))))
    text = F.when(F.col("_spdx").isNull() & F.arrays_overlap(_distinct_terms(), _constant(model.anchors)), F.col("text"))
    asked = cut(bounded_batches(files).select(F.explode(wanted(text)).alias("_term")).distinct())
    few = small(asked, BROADCAST_TERMS)
    counts = files.select(F.explode(_distinct_terms()).alias("_term")).join(F.broadcast(asked) if few else asked, "_term", "left_semi").groupBy("_term").agg(F.count(F.lit(1)).alias("_n"))
    if few:
        known = files.sparkSession.sparkContext.broadcast({r["_term"]: r["_n"] for r in counts.collect()})

        @F.pandas_udf(kind)
        def own(texts: pd.Series) -> pd.DataFrame:
            return judged(texts, (known.value for _ in texts))

        out = bounded_batches(files).withColumn("_own", own(text))
    else:

        @F.pandas_udf(kind)
        def own_with(texts: pd.Series, names: pd.Series, numbers: pd.Series) -> pd.DataFrame:
            return judged(texts, ({} if n is None else dict(zip(n, c, strict=True)) for n, c in zip(names, numbers, strict=True)))

        rows = written(bounded_batches(files).withColumns({"_row": F.monotonically_increasing_id(), "_wanted": wanted(text)}))
        mine = rows.select("_row", F.explode("_wanted").alias("_term")).join(counts, "_term").groupBy("_row").agg(F.collect_list(F.struct("_term", "_n")).alias("_k"))
        met = rows.where("_wanted is not null").join(mine, "_row", "left").withColumn("_own", own_with("text", F.col("_k._term"), F.col("_k._n")))
        none = F.lit(None).cast("struct<own_license:string,own_score:double,own_licenses:array<string>>")
        out = met.drop("_k").unionByName(rows.where("_wanted is null").withColumn("_own", none)).drop("_row", "_wanted")
    score = F.when(F.col("_spdx").isNotNull(), F.lit(1.0)).when(F.col("_own.own_license").isNotNull(), F.col("_own.own_score"))
    said = F.when(F.col("_spdx").isNotNull(), F.array("_spdx")).otherwise(F.col("_own.own_licenses"))
    return out.withColumns({"own_license": F.coalesce("_spdx", "_own.own_license"), "own_score": score, "own_licenses": said}).drop("_own", "_spdx")


def inherit(files: DataFrame) -> DataFrame:
    """Adds directory, license and license_from to scanned files (path, own_license, own_score).

    A file's own match comes first; else the licence file (named license, licence, copying or
    unlicense, with any ending) of the nearest directory at or above its own. Of several in one
    directory the highest score counts, then the first path. A null path has no directory.
    """
    slash = F.expr("length(path) - length(substring_index(path, '/', -1)) - 1")
    files = files.drop("directory", "license", "license_from").withColumn("directory", F.when(F.col("path").isNotNull(), F.substring("path", F.lit(1), F.greatest(slash, F.lit(0)))))
    named = F.lower(F.substring_index("path", "/", -1)).rlike(r"^(un)?licen[sc]e|^copying")
    granted = files.where(named & F.col("own_license").isNotNull()).groupBy("directory")
    granted = granted.agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("g")).select(F.col("directory").alias("above"), F.col("g.own_license").alias("inherited"))
    parts = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(F.split("directory", "/"))
    up = F.expr("transform(sequence(0, size(parts)), n -> array_join(slice(parts, 1, n), '/'))")
    chain = files.select("directory").where("directory is not null").distinct().withColumn("parts", parts).select("directory", F.explode(F.array_distinct(up)).alias("above"))
    nearest = chain.join(granted, "above").groupBy("directory").agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("n"))
    out = join_by_key(files, nearest, "directory", "path", "left")
    return out.withColumns(
        {
            "license": F.coalesce("own_license", F.col("n.inherited")),
            "license_from": F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("n.above")),
        }
    ).drop("n")


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licences of files (path, text): own_license, own_score, own_licenses, directory, license, license_from are added.

    Null or empty text: no own licence. Very long texts: every line and run, and the whole, is scored. Null path: own
    licence only. Repeated rows and ties: each row has its result. Clashing columns are replaced.
    Empty table: no rows.
    """
    return inherit(scan(files, matcher(files, templates, threshold)))
