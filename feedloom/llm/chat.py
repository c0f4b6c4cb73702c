"""Chat formatting: transcripts are parsed by a hidden Markov model over lines, then rendered in one form.

A transcript is a sequence of chunks of text (a file, or the parts it came in), each of some lines.
For every role there are two states: a line that begins a turn, and one that goes on with it. A line
is seen through its speaker marker (none, a clear or a doubtful one of some role), whether it asks, its length class, and whether
the line before it is blank. The most likely states are found by Viterbi over segments of
``SEGMENT`` chunks: each is summed up by a matrix (best score from the state before it to its last
one), the matrices of a transcript are folded, and each segment is then decoded between its fixed
ends. Transcripts of one segment, nearly all, are decoded at once. So a transcript of any length is
spread over tasks; what is held for it in one place is 72 numbers for every ``SEGMENT`` chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROLES = ["system", "user", "assistant", "tool"]
R = len(ROLES)
#: States: begin of each role, then going on of each role.
STATES = 2 * R
SEGMENT = 64
#: Bytes of text that a task decodes, about; segments are dealt to such groups by hash.
GROUP_BYTES = 8 << 20
# Names that transcripts give to speakers, clearly or in a way that plain text may hold as well.
CLEAR = {"system": "system|sys", "user": "user|human", "assistant": "assistant|ai|bot|gpt|chatgpt", "tool": "tool|function"}
DOUBTFUL = {"system": "instruction|instructions", "user": "q|question|prompter|customer|me", "assistant": "a|answer|agent|model", "tool": "observation"}
_NAMES = "|".join([*CLEAR.values(), *DOUBTFUL.values()])
#: A marker that opens a line: <|im_start|>user or ### User (alone), <|user|>, [user]: or **User:**, and User: (any case).
MARKER = rf"(?i)^[ \t]*(?:(?:<\|im_start\|>|#+)[ \t]*({_NAMES}):?[ \t]*$|(?:<\||\[|\*\*)({_NAMES})(?:\|>|\]:?|:?\*\*:?)[ \t]*|({_NAMES})[ \t]*:[ \t]*)"
_MARKER = re.compile(MARKER)
# Marks that end a turn; they are kept apart from its text, with the blank lines after it.
END_MARKS = ("<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|end|>", "</s>")
#: How much less likely a turn of the system or of a tool is where no marker names it: it takes more than a short line to open one.
UNNAMED = 0.02
#: How much less likely a turn begins with a blank line.
BLANK_OPENING = 1e-3
#: Values of each feature: no marker, clear ones, doubtful ones; asks; length class (0: blank); after a blank line.
MARKERS, FEATURES = 2 * R + 1, (2 * R + 1, 2, 6, 2)


def _role_number(name: Column, names: list[dict[str, str]]) -> Column:
    """The position of a speaker's name in ROLES, from 0 in the first of ``names``, from R in the second; null for others."""
    number = F.lit(None).cast("int")
    for k, known in enumerate(names):
        for i, role in enumerate(ROLES):
            number = F.when(name.rlike(f"^({known[role]})$"), F.lit(k * R + i)).otherwise(number)
    return number


def line_codes(text: Column) -> Column:
    """One small number for each line of a text: marker, question and length class."""

    def code(line: Column) -> Column:
        name = F.lower(F.concat(*[F.regexp_extract(line, MARKER, i) for i in (1, 2, 3)]))
        marker = F.when(line.rlike(MARKER), F.coalesce(_role_number(name, [CLEAR, DOUBTFUL]) + 1, F.lit(0))).otherwise(F.lit(0))
        size = F.length(F.trim(line))
        size = F.when(F.trim(line).isin(*END_MARKS), 0).otherwise(size)
        length = F.when(size == 0, 0).when(size < 20, 1).when(size < 80, 2).when(size < 300, 3).when(size < 1200, 4).otherwise(5)
        return ((marker * 2 + F.rtrim(line).endswith("?").cast("int")) * 6 + length).cast("int")

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), code)


@dataclass
class RoleModel:
    """Log probabilities: start and move over states, see[state, code, after a blank line]."""

    start: np.ndarray
    move: np.ndarray
    see: np.ndarray


def _emissions(counts: np.ndarray) -> np.ndarray:
    """log P(code, after | state) from counts (states, marker, asks, length, after), with the features taken as independent.

    Markers are counted over all roles of a kind of line as none, the line's own role's or another's, clear or
    doubtful, with a twentieth of the weight for what markers mean: a line that begins a turn carries its own role's
    or none, other lines carry none. The other features' tables are smoothed by those of all roles. So a
    role that was never seen looks like the others, and follows its markers.
    """
    see = np.zeros((STATES, *FEATURES))
    meaning = np.array([[2.0, 4.0, 1.0, 0.02, 0.02], [4.0, 0.02, 0.2, 0.02, 0.05]])
    group = np.full((R, MARKERS), 3)
    group[:, 0] = 0
    group[:, 1 + R :] = 4
    for i in range(R):
        group[i, 1 + i], group[i, 1 + R + i] = 1, 2
    share = np.array([1, 1, 1, R - 1, R - 1])
    for kind in range(2):
        states = range(kind * R, kind * R + R)
        for f in range(1, 4):
            table = counts.sum(axis=tuple(x + 1 for x in range(4) if x != f))
            pooled = table[kind * R : kind * R + R].sum(axis=0) + 0.5
            for s in states:
                p = table[s] + 4 * pooled / pooled.sum()
                see[s] += np.log(p / p.sum()).reshape([-1 if x == f else 1 for x in range(4)])
        marks = counts[kind * R : kind * R + R].sum(axis=(2, 3, 4))
        seen = np.bincount(group.ravel(), marks.ravel(), minlength=5)
        p = 0.95 * seen / max(1.0, seen.sum()) + 0.05 * meaning[kind] / meaning[kind].sum()
        for s in states:
            see[s] += np.log((p / p.sum() / share)[group[s % R]])[:, None, None, None]
    see[[0, 3], 0] += np.log(UNNAMED)
    see[:R, 0, :, 0] += np.log(BLANK_OPENING)
    return see.reshape(STATES, -1, 2)


def train(chunks: DataFrame) -> RoleModel:
    """Learn from chunks (conv_id, turn, role, text) that hold one turn each and whose role is known.

    Roles in other spellings count as the role they name; null and unknown roles are not counted.
    Only a few hundred counts reach the driver. Without any chunk the model follows markers alone.
    """
    codes = line_codes(F.col("text").cast("string"))
    role = _role_number(F.lower(F.trim("role")), [CLEAR, DOUBTFUL]) % R
    known = chunks.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), role.alias("_role"), codes.alias("_codes")).where("_role is not null")
    blank = lambda c: (c % 6 == 0).cast("int")
    known = cut(known.withColumn("_ends", blank(F.element_at("_codes", -1))))
    # counted by place first, so that repeated chunks of one place never meet one by one; several chunks before one share its weight
    at = F.struct(F.col("_role").alias("before"), F.col("_ends").alias("after"))
    follows = known.groupBy("conv_id", (F.col("turn") + 1).alias("turn"), at.alias("p")).count().groupBy("conv_id", "turn").agg(F.collect_list(F.struct("p", "count")).alias("places"), F.sum("count").alias("all"))
    opening = known.groupBy("conv_id", "turn", "_role", F.get("_codes", F.lit(0)).alias("code")).count()
    first = opening.join(follows, ["conv_id", "turn"], "left").select("turn", "_role", "code", "count", "all", F.explode_outer("places").alias("f"))
    share = F.sum(F.col("count") * F.coalesce(F.col("f.count") / F.col("all"), F.lit(1.0)))
    first = first.groupBy(F.col("f.p.before").alias("_before"), "_role", "code", F.coalesce("f.p.after", F.lit(0)).alias("after"), (F.col("turn") <= 0).alias("opens")).agg(F.round(share, 6).alias("count"))
    pairs = F.explode(F.transform(F.slice("_codes", 2, 1 << 30), lambda c, i: F.struct(c.alias("code"), blank(F.element_at("_codes", i + 1)).alias("after"))))
    later = known.where(F.size("_codes") > 1).select("_role", pairs.alias("c")).groupBy("_role", "c.code", "c.after").count()
    lengths = known.groupBy("_role").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.size("_codes") > 1).alias("several"), F.sum(F.size("_codes") - 1).alias("going"))
    counts = np.zeros((STATES, *FEATURES))
    start, after = np.full(R, 0.5), np.full((R, R), 0.5)
    for r in first.collect():
        counts[r["_role"], r["code"] // 12, r["code"] // 6 % 2, r["code"] % 6, r["after"]] += r["count"]
        if r["_before"] is not None:
            after[r["_before"], r["_role"]] += r["count"]
        elif r["opens"]:
            start[r["_role"]] += r["count"]
    for r in later.collect():
        counts[R + r["_role"], r["code"] // 12, r["code"] // 6 % 2, r["code"] % 6, r["after"]] += r["count"]
    turns, several, going = np.zeros(R), np.zeros(R), np.zeros(R)
    for r in lengths.collect():
        turns[r["_role"]], several[r["_role"]], going[r["_role"]] = r["turns"], r["several"], r["going"]
    pooled = (several.sum() + 1) / (turns.sum() + 2), (going.sum() - several.sum() + 1) / (going.sum() + 2)
    goes_on = np.concatenate([(several + 4 * pooled[0]) / (turns + 4), (going - several + 4 * pooled[1]) / (going + 4)])
    after /= after.sum(axis=1, keepdims=True)
    move = np.full((STATES, STATES), 1e-300)
    for s in range(STATES):
        move[s, :R] = (1 - goes_on[s]) * after[s % R]
        move[s, R + s % R] = goes_on[s]
    begin = np.concatenate([start / start.sum(), np.full(R, 1e-300)])
    return RoleModel(np.log(begin), np.log(move), _emissions(counts))


def viterbi(seen: list[np.ndarray], move: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The best path of each sequence of scores (steps x states); ``first`` and ``last`` (one row each) are added at the ends. Ties go to the lower state."""
    order = np.argsort([-len(s) for s in seen], kind="stable")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
    at = 0
    while at < len(order):
        steps = len(seen[order[at]])
        some = order[at : at + max(1, (1 << 15) // steps)]
        at += len(some)
        sizes = np.array([len(seen[k]) for k in some])
        scores = np.zeros((steps, len(some), STATES))
        for i, k in enumerate(some):
            scores[: sizes[i], i] = seen[k]
        score = first[some] + scores[0]
        back = np.zeros((steps, len(some), STATES), np.int8)
        for t in range(1, steps):
            live = int((sizes > t).sum())
            options = score[:live, :, None] + move
            back[t, :live] = options.argmax(axis=1)
            score[:live] = options.max(axis=1) + scores[t, :live]
        state = (score + last[some]).argmax(axis=1)
        path = np.zeros((steps, len(some)), np.int64)
        rows = np.arange(len(some))
        for t in range(steps - 1, -1, -1):
            path[t] = state
            going = sizes > t
            state = np.where(going, back[t, rows, state], state)
        for i, k in enumerate(some):
            out[k] = path[: sizes[i], i]
    return out


def seen_scores(codes: np.ndarray, before: int, model: RoleModel) -> np.ndarray:
    """Scores (lines x states) of the lines of a segment, the line before which is blank if ``before`` is 1."""
    after = np.concatenate([[before], (codes[:-1] % 6 == 0).astype(np.int64)])
    return model.see[:, codes, after].T


def _turns(chunks: list[str], codes: list[np.ndarray], states: np.ndarray) -> Iterator[tuple[int, int, str, str, int]]:
    """(turns begun so far, role, marker, text, end marks and blank lines after it) of each turn, or part of a turn, of a segment."""
    lines = [line for c in chunks for line in c.split("\n")]
    marks = np.concatenate(codes) // 12
    begun, start = 0, 0
    edges = [*np.flatnonzero(states < R), len(lines)]
    if edges[0] != 0:
        edges = [0, *edges]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        state, marker, part = int(states[start]), "", lines[start:end]
        if state < R:
            begun += 1
            if marks[start] and (marks[start] - 1) % R == state and (m := _MARKER.match(part[0])):
                marker, part[0] = m[0], part[0][m.end() :]
                if not part[0] and m[1] and len(part) > 1:
                    marker, part = marker + "\n", part[1:]
        size = len(part)
        while size > 1 and not part[size - 1].strip(" \t\r"):
            size -= 1
        whole, text = "\n".join(part), "\n".join(part[:size])
        while (bare := text.rstrip(" \t\r\n")).endswith(END_MARKS):
            text = bare[: -len(next(m for m in END_MARKS if bare.endswith(m)))].rstrip(" \t\r\n")
        yield begun, state % R, marker, text, whole[len(text) :]


def escaped(text: Column) -> Column:
    """Text in which no role header can be read: ``<|`` becomes ``<\\|`` (and one backslash more where there are some)."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def parse(chunks: DataFrame, model: RoleModel) -> DataFrame:
    """Turns recovered from transcripts (conv_id, turn, text), whose chunks are ordered by turn and may hold any number of lines.

    Returns conv_id, turn_found (from 0), piece (a turn that crosses segments has several, to be
    joined in order), role_found, marker, text, blank (end marks and blank lines after it), rendered. Markers, texts and blanks in
    order, joined by line breaks, are the transcript again. rendered is ``<|role|>``, a line break, the escaped text and
    a line break; later pieces have no header.

    Null text: one empty line. Null turn: before all others, in the order of a hash. Equal turns: in the order of a hash of the text.
    Null conv_id: one transcript. Repeated rows: chunks of their own. Other columns are left out. Empty table: no rows.
    """
    rows = chunks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    segment = F.when(F.col("turn").isNull(), F.shiftright(tie, 48) - (1 << 60)).otherwise(F.floor(F.col("turn") / SEGMENT)).cast("long")
    rows = rows.withColumns({"tie": tie, "segment": segment, "codes": line_codes(F.col("text"))})
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id", "segment"), F.lit(int(size // GROUP_BYTES) + 1)).cast("int"))
    at_end = np.arange(STATES)

    def segments(p: pd.DataFrame) -> list[pd.DataFrame]:
        """The segments of a bucket, each in order of its chunks."""
        p = p.sort_values(["conv_id", "segment", "turn", "tie"], na_position="first", kind="stable", ignore_index=True)
        key = pd.DataFrame({"c": p.conv_id.fillna(-1), "n": p.conv_id.isna(), "s": p.segment})
        edge = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        return [p.iloc[start:end] for start, end in zip(edge, [*edge[1:], len(p)], strict=True)]

    def sum_up(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in segments(p):
            codes = np.concatenate(part.codes.to_list())
            for before in (0, 1):
                seen = seen_scores(codes, before, model)
                best = np.concatenate([model.move + seen[0], [model.start + seen[0]]])
                for s in seen[1:]:
                    best = (best[:, :, None] + model.move).max(axis=1) + s
                out.append((part.conv_id.iloc[0], part.segment.iloc[0], before, int(codes[-1] % 6 == 0), best.astype(np.float32).ravel().tolist()))
        return pd.DataFrame(out, columns=["conv_id", "segment", "before", "ends", "best"]).astype({"conv_id": "Int64"})

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["segment", "before"])
        score, back, blank, entered = None, [], 0, []
        for both, ends in zip(np.stack(p.best.to_list()).reshape(-1, 2, STATES + 1, STATES), p.ends.to_numpy()[::2], strict=True):
            best = both[blank].astype(np.float64)
            entered.append(blank)
            blank = int(ends)
            if score is None:
                score = best[STATES]
                continue
            options = score[:, None] + best[:STATES]
            back.append(options.argmax(axis=0))
            score = options.max(axis=0)
        leave = [int(score.argmax())]
        for b in reversed(back):
            leave.append(int(b[leave[-1]]))
        leave = leave[::-1]
        one = p.iloc[::2]
        return pd.DataFrame({"conv_id": one.conv_id.astype("Int64"), "segment": one.segment, "before": entered, "enter": [-1, *leave[:-1]], "leave": leave})

    def decode(p: pd.DataFrame) -> pd.DataFrame:
        parts = segments(p)
        first, last, seen = np.zeros((len(parts), STATES)), np.zeros((len(parts), STATES)), []
        for k, part in enumerate(parts):
            enter, leave, before = part.enter.iloc[0], part.leave.iloc[0], part.before.iloc[0]
            first[k] = model.start if pd.isna(enter) or enter < 0 else model.move[int(enter)]
            if not pd.isna(leave):
                last[k] = np.where(at_end == leave, 0.0, -1e300)
            seen.append(seen_scores(np.concatenate(part.codes.to_list()), 0 if pd.isna(before) else int(before), model))
        out = []
        for part, states in zip(parts, viterbi(seen, model.move, first, last), strict=True):
            conv, segment = part.conv_id.iloc[0], part.segment.iloc[0]
            out += [(conv, segment, *t) for t in _turns(list(part.text), list(part.codes), states)]
        return pd.DataFrame(out, columns=["conv_id", "segment", "begun", "role", "marker", "text", "blank"]).astype({"conv_id": "Int64"})

    bounds = rows.groupBy("conv_id").agg(F.min("segment").alias("low"), F.max("segment").alias("high")).where("low < high").select(F.col("conv_id").alias("_k"))
    long_ones = cut(rows.select("conv_id", "segment", "turn", "tie", "codes", "bucket").join(bounds, F.col("conv_id").eqNullSafe(F.col("_k")), "left_semi"))
    several = not long_ones.isEmpty()
    if several:
        sums = long_ones.groupBy("bucket").applyInPandas(sum_up, "conv_id long, segment long, before int, ends int, best array<float>")
        ends = sums.groupBy("conv_id").applyInPandas(fold, "conv_id long, segment long, before int, enter int, leave int").toDF("_c", "_s", "before", "enter", "leave")
        rows = rows.join(ends, rows["conv_id"].eqNullSafe(ends["_c"]) & (rows["segment"] == ends["_s"]), "left").drop("_c", "_s")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("int") for c in ("before", "enter", "leave")})
    found = rows.groupBy("bucket").applyInPandas(decode, "conv_id long, segment long, begun long, role int, marker string, text string, blank string")
    if several:
        found = cut(found)
        begun = found.groupBy("conv_id", "segment").agg(F.max("begun").alias("n"))
        base = begun.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("segment")) - F.col("n")).alias("base"))
        found = found.join(base, found["conv_id"].eqNullSafe(base["_c"]) & (found["segment"] == base["_s"])).drop("_c", "_s")
        found = found.withColumn("turn_found", F.col("base") + F.col("begun") - 1)
        opens = F.min("segment").over(Window.partitionBy("conv_id", "turn_found"))
        found = found.withColumn("piece", F.col("segment") - opens).drop("base")
    else:
        found = found.withColumns({"turn_found": F.col("begun") - 1, "piece": F.lit(0).cast("long")})
    name = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role") + 1)
    found = found.withColumn("role_found", name)
    rendered = F.concat(F.when(F.col("piece") == 0, F.concat(F.lit("<|"), "role_found", F.lit("|>\n"))).otherwise(F.lit("")), escaped(F.col("text")), F.lit("\n"))
    return found.select("conv_id", "turn_found", "piece", "role_found", "marker", "text", "blank", rendered.alias("rendered"))


def as_transcripts(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, ...) as the chunks of raw transcripts.

    Three in four open with a speaker marker, in one of four styles by conversation; in every other
    conversation a blank line ends each turn.
    """
    name = F.initcap("role")
    part = lambda n, *what: F.pmod(F.xxhash64(*what), F.lit(n))
    style = part(4, F.lit("style"), "conv_id")
    marker = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("<|"), F.lower("role"), F.lit("|>"))).when(style == 2, F.concat(F.lit("**"), name, F.lit(":** ")))
    marker = marker.otherwise(F.concat(F.lit("### "), name, F.lit("\n")))
    marked = part(4, F.lit("marked"), "conv_id", "turn") != 0
    text = F.concat(F.when(marked, F.coalesce(marker, F.lit(""))).otherwise(F.lit("")), F.coalesce("text", F.lit("")), F.when(part(2, F.lit("blank"), "conv_id") == 0, F.lit("\n")).otherwise(F.lit("")))
    return turns.withColumn("text", text)
