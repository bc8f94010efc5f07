"""Personal data: base patterns that always count, and further spans picked among proposals by boosted trees.

The generators propose spans of each kind far more freely than the base patterns: parts of a longer run of digits, numbers
without a plus or with other separators, addresses with a written-out at or dot. The trees learn from made-up disguised data laid into the corpus' own texts, so
that no base pattern decides a label: a proposal that is what was laid there counts as one, a decoy and every other proposal of the text that the base patterns don't hold as none.
A threshold per kind, calibrated on texts kept from training, selects what is added to the base spans.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routecover.llm.boosting import Boosted, fit, threshold_for
from routecover.llm.texts import strings

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]?[0-9][0-9 ().\-]{5,}[0-9]")
GROUP = re.compile(r"[0-9]+")
AT = re.compile(r" ?(?:@|[\[(](?:at|AT)[\])]) ?")
HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}){3,}(?![0-9])")
USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def valid(kind: str, text: str) -> bool:
    """The base rule's test of a match."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))
    n = len(digits := only_digits(text))
    if kind == "card":
        return 12 <= n <= 19 and luhn(digits)
    return kind == "email" or 9 <= n <= 15


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All leftmost matches of the base patterns, with whether they pass; each pattern is followed in linear time."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        after = DOMAIN.match(text, at)
        begin = at
        while begin > free and (text[begin - 1] in "._%+-" or (text[begin - 1].isascii() and text[begin - 1].isalnum())):
            begin -= 1
        if after and begin < at:
            out.append(("email", begin, after.end(), True))
            free = after.end()
        else:
            free = max(free, begin)
        at = text.find("@", max(at + 1, free))
    for kind, pattern in (("ip", QUAD), ("card", DIGITS), ("phone", PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end(), valid(kind, m.group())) for m in pattern.finditer(text)]
    return out


def proposals(text: str) -> set[Span]:
    """Overlapping spans that might be personal data, over the whole text."""
    out: set[Span] = set()
    free = 0
    for m in AT.finditer(text):
        begin = m.start()
        while begin > free and text[begin - 1] in USER:
            begin -= 1
        host = HOST.match(text, m.end())
        if host and begin < m.start():
            out.add(("email", begin, host.end()))
        free = m.end()
    for m in DOTTED.finditer(text):
        parts = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m.group())]
        out |= {("ip", parts[i][0], parts[i + 3][1]) for i in range(len(parts) - 3)}
    for m in NUMBER.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m.group())]
        for i, (begin, _) in enumerate(groups):
            digits = 0
            lead = begin - (text[begin - 1] in "+(") if begin else begin
            lead -= lead > 1 and text[lead] == "(" and text[lead - 1] == "+"
            for start, end in groups[i:]:
                digits += end - start
                if digits > 19:
                    break
                if digits >= 12:
                    out.add(("card", begin, end))
                if 9 <= digits <= 15:
                    out.add(("phone", lead, end))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal: counts, shape, checks of its digits, and what stands around it."""
    kind, begin, end = span
    s = text[begin:end]
    before, after = text[max(0, begin - 1) : begin], text[end : end + 1]
    runs = GROUP.findall(s)
    groups = [len(g) for g in runs]
    left = re.findall(r"\w+", text[max(0, begin - 32) : begin])
    word = left[-1].lower() if left else ""
    tail = re.findall(r"[A-Za-z]+$", s)
    return [
        float(KINDS.index(kind)), float(len(s)), float(sum(groups)), float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(s.startswith("+")), float(s.count("(")), float(s.count("-")), float(s.count(".")), float(s.count(" ")), float(s.count("[")),
        float(luhn("".join(runs))), float(kind == "ip" and all(int(g[-4:]) <= 255 for g in runs)), float("@" in s), float(len(tail[0]) if tail else 0),
        float(before.isalnum()), float(before in "+-.(" and before != ""), float(after.isalnum()), float(after in "-.@" and after != ""),
        float(text[max(0, begin - 2) : begin - 1].isdigit()), float(text[end + 1 : end + 2].isdigit()),
        float(zlib.crc32(word.encode()) % 64), float(len(word)),
    ]


def disguised(kind: str, r: random.Random) -> tuple[str, str]:
    """What stands before it, and a made-up span of the kind in a form that the base patterns don't match."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == "email":
        user, labels = letters(r.randint(2, 9)) + r.choice(["", digits(2), "." + letters(4)]), [letters(r.randint(3, 9)), *[letters(5)] * r.randint(0, 1), r.choice(["com", "org", "net", "de", "fr", "io"])]
        at, dot = r.choice([(" @ ", "."), ("[at]", "."), ("(at)", "."), (" [at] ", "."), (" (at) ", "."), ("@", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        return "", user + at + dot.join(labels)
    if kind == "ip":
        return "", r.choice(["[.]", "(.)", " . "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        form = r.randint(0, 3)
        if form == 0:  # read on from a number before it
            return digits(r.randint(12, 16)) + " ", body
        return "", [".", "  ", " - "][form - 1].join(body[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return "", r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1 ({a}) {b}-{c}", f"0049 {a} {b}{c}", f"1-{a}-{b}-{c}"])


def decoy(kind: str, r: random.Random) -> tuple[str, str]:
    """What stands before it, and something that looks like the kind but isn't: a number of wrong check digit, parts over 255, digits of a longer code."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        parts[r.randrange(4)] = str(r.randint(256, 999))
        return "", r.choice([".", "[.]", "(.)", " . "]).join(parts)
    if kind == "card":
        body = digits(15)
        body += next(c for c in r.sample("0123456789", 10) if not luhn(body + c))
        return r.choice(["", "", digits(r.randint(12, 16)) + " "]), r.choice(["", "", ".", "  ", " - "]).join(body[i : i + 4] for i in range(0, 16, 4))
    return "", "".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) + digits(r.randint(9, 12)) + "".join(r.choice("0123456789abcdef") for _ in range(r.randint(0, 9)))


def laid_into(text: str, r: random.Random) -> tuple[str, set[Span], set[Span]]:
    """``text`` with one disguised span of each kind, and one decoy of most, each laid in place of a space (one at the end, if it has none); the spans and the decoys."""
    places = [m.start() for m in re.finditer(" ", text)]
    what = [(k, True) for k in KINDS] + [(k, False) for k in ("ip", "card", "phone")]
    picked = sorted(r.sample(places, min(len(places), len(what)))) or [len(text)]
    out, laid, decoys, at, size = [], set(), set(), 0, 0
    for place, (kind, real) in zip(picked, r.sample(what, len(picked))):
        before, span = disguised(kind, r) if real else decoy(kind, r)
        out += [text[at:place], " ", before]
        size += place - at + 1 + len(before)
        (laid if real else decoys).add((kind, size, size + len(span)))
        out += [span, " "]
        size += len(span) + 1
        at = min(place + 1, len(text))
    return "".join([*out, text[at:]]), laid, decoys


def chosen(text: str, model: Boosted | None, thresholds: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text; an added span overlaps no other span of its kind."""
    base = [(k, b, e) for k, b, e, fine in base_matches(text) if fine]
    if model is None:
        return base, []
    known = set(base)
    maybe = sorted(x for x in proposals(text) if x not in known)
    if not maybe:
        return base, []
    p = model.probability(np.array([features(text, x) for x in maybe]))
    taken: dict[str, list[tuple[int, int]]] = {k: [(b, e) for kk, b, e in base if kk == k] for k in KINDS}
    added = []
    for i in np.lexsort((np.arange(len(maybe)), -p)).tolist():
        kind, begin, end = maybe[i]
        if p[i] >= thresholds.get(kind, 1.1) and all(end <= b or e <= begin for b, e in taken[kind]):
            taken[kind].append((begin, end))
            added.append(maybe[i])
    return base, added


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind in the listed order."""
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def hash_below(column: Column, share: float) -> Column:
    """Whether the 64-bit hash of a column lies in the lowest ``share`` of all hashes; holds for any share above 2 ** -60."""
    return F.xxhash64(column) <= F.lit(min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)).cast("long")


def learn_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, per_kind: int = 50, precision: float = 0.98, least: float = 0.9
) -> tuple[Boosted | None, dict[str, float]]:
    """Train on about ``sample`` texts, chosen by hash of the id, with disguised spans and decoys laid into them; a quarter of them calibrates the thresholds.

    Of a text at most ``per_kind`` other proposals of a kind are taken as examples, those of the smallest hashes of their places. Proposals that base spans or failed base matches
    of the text itself hold are unlabelled, and left out. Of a few rows all are used. ``model`` is None if there is no text; a kind without a
    threshold of the wanted precision gets no added spans. What is laid is fixed by the text, so the model is the same in every run.
    """
    usable = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    total = usable.count()
    drawn = usable.where(hash_below(F.col(id_col), sample / total)) if total > sample else usable

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, values = [], []
            for name, text in zip(batch.column(0).to_pylist(), strings(batch)):
                seed = zlib.crc32(text.encode())
                text, laid, decoys = laid_into(text, random.Random(seed))
                inside = lambda x, y: x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]
                matches = [m[:3] for m in base_matches(text)]
                unlabelled = [m for m in matches if not any(m[1] < e and b < m[2] for _, b, e in laid | decoys)]
                by_kind: dict[str, list[Span]] = {k: [] for k in KINDS}
                for x in proposals(text) - laid - set(matches):
                    if not any(inside(x, m) for m in unlabelled):
                        by_kind[x[0]].append(x)
                order = lambda x: (zlib.crc32(f"{x[1]}:{x[2]}".encode()), x)
                rows = [(x, 1.0) for x in sorted(laid)] + [(x, 0.0) for k in KINDS for x in sorted(by_kind[k], key=order)[:per_kind]]
                if rows:
                    folds.append(zlib.crc32(str(name).encode()) % 4)
                    values.append(np.array([[*features(text, x), y] for x, y in rows], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(values, pa.binary())], names=["fold", "rows"])

    rows = drawn.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(label, "fold int, rows binary").collect()
    if not rows:
        return None, {}
    parts = sorted((r["fold"], bytes(r["rows"])) for r in rows)
    width = len(features("", ("email", 0, 0))) + 1
    data = [np.frombuffer(x, np.float32).reshape(-1, width) for _, x in parts]
    fold = np.repeat([f for f, _ in parts], [len(x) for x in data])
    x, y = np.concatenate(data)[:, :-1].astype(np.float64), np.concatenate(data)[:, -1].astype(np.float64)
    if not (fold == 0).any() or not (fold != 0).any():
        fold = np.arange(len(fold)) % 4  # a few texts, all of one part
    if len(np.unique(y[fold != 0])) < 2:
        return None, {}
    model = fit(x[fold != 0], y[fold != 0])
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = (fold == 0) & (x[:, 0] == k)
        if y[own].any():
            thresholds[kind] = threshold_for(model.probability(x[own]), y[own], precision, least)
    return model, thresholds


def find_spans(docs: DataFrame, model: Boosted | None, thresholds: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, base, spans)`` for every row: the base spans and all spans, as joined text; places are code points, ends exclusive.

    An added span overlaps no base span and no likelier added span of its kind (of equally likely ones, none that begins earlier). A null or empty text has none. Whole texts are read, in time linear in their length; repeated rows keep their rows; other
    columns are ignored. ``redact`` replaces the spans.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_texts, all_texts = [], [], []
            for text in strings(batch):
                base, added = chosen(text, model, thresholds)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                base_texts.append(joined(base))
                all_texts.append(joined(base + added))
            each = list(zip(*counts)) if counts else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in each), pa.array(base_texts, pa.string()), pa.array(all_texts, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, schema)


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for x in spans.split(",") if spans else []:
        kind, begin, end = x.split(":")
        if int(begin) >= at:
            out += [text[at : int(begin)], f"<{kind}>"]
            at = int(end)
    return "".join([*out, text[at:]])
