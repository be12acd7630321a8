"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The field scores whole candidate segments (one to ``max_tokens`` tokens around
a digit or an at sign) for each kind and for what they follow; dynamic
programming over a window of tokens picks boundaries and kinds jointly. Its
weights are fitted on generated labelled windows, by gradient ascent on the
likelihood of whole segmentations.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import set_aside, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


@dataclass(frozen=True)
class FieldConfig:
    """``max_tokens`` and ``max_chars`` (the longest mail address) bound a segment, ``margin`` is what a span must gain over none."""

    max_tokens: int = 5
    max_chars: int = 320
    windows: int = 960
    epochs: int = 8
    rate: float = 0.4
    decay: float = 0.002
    margin: float = 1.0
    seed: int = 11


# --- fixed patterns -------------------------------------------------------------------------

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match of this kind takes whole digit runs, so no match starts inside one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches by way of each at sign; no run of characters is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at)  # the local part must not cross this sign
        at = text.find("@", max(at + 1, end))


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns by start, then kind; failing matches are dropped."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if HAS_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


HAS_DIGIT = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
EDGE_LEFT, EDGE_RIGHT = "\"'<[{,;:=!?", "\"'>]},;:.!?"
#: Words that announce a kind, as the token or two before a segment.
CUES = {
    "email": "email", "mail": "email", "e-mail": "email", "contact": "email", "correo": "email", "courriel": "email",
    "ip": "ip", "host": "ip", "address": "ip", "server": "ip", "login": "ip",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "karte": "card", "carte": "card", "tarjeta": "card",
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "telefon": "phone", "tél": "phone",
}
GROUPS = re.compile(r"[0-9]+")
MAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]+)+")


@functools.lru_cache(maxsize=8192)
def span_features(segment: str, cue: str, n_tokens: int) -> tuple[str, ...] | None:
    """Features of a whole candidate segment; None if no kind can have it."""
    if MAIL_SHAPE.fullmatch(segment):
        return ("mail-shape", f"cue:{cue}", f"tokens:{n_tokens}")
    digits = "".join(GROUPS.findall(segment))
    rest = segment
    for x in "+().-/ ":
        rest = rest.replace(x, "")
    if not 7 <= len(digits) <= 19 or rest != digits:
        return None
    groups = GROUPS.findall(segment)
    out = [f"digits:{len(digits)}", f"groups:{min(len(groups), 6)}", f"cue:{cue}", f"tokens:{n_tokens}"]
    out += [name for x, name in (("+", "plus"), ("(", "paren"), (".", "dot"), ("-", "dash"), (" ", "space"), ("/", "slash")) if x in segment]
    out.append("sizes:" + "-".join(str(min(len(g), 9)) for g in groups[:6]))
    if len(digits) >= 12:
        out.append("luhn" if luhn(digits) else "no-luhn")
    if len(groups) == 4 and segment.count(".") == 3:
        out.append("octets" if _octets(".".join(groups)) else "no-octets")
    return tuple(out)


class Window:
    """Tokens around anchors, with the candidate segments that end at each token."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], max_tokens: int, max_chars: int):
        self.n = len(tokens)
        self.ends: list[list[tuple[int, int, int, tuple[str, ...]]]] = [[] for _ in tokens]
        #: Where a segment of the token before token i ends, its edge signs cut off.
        self.reach = [-1] + [b - len(text[a:b]) + len(text[a:b].rstrip(EDGE_RIGHT)) for a, b in tokens]
        words = [text[a:b] for a, b in tokens]
        anchored = [bool(ANCHOR.search(w)) for w in words]
        for j in range(self.n):
            for i in range(j, max(-1, j - max_tokens), -1):
                if not anchored[i] and not words[i].strip("+().-/"):
                    continue
                if not anchored[i]:
                    break  # a segment holds anchors and bare signs only
                a, b = tokens[i][0], tokens[j][1]
                if b - a > max_chars:
                    break
                while a < b and text[a] in EDGE_LEFT:
                    a += 1
                while a < b and text[b - 1] in EDGE_RIGHT:
                    b -= 1
                if text[a:b].startswith("(") and ")" not in text[a:b]:
                    a += 1
                if text[a:b].endswith(")") and "(" not in text[a:b]:
                    b -= 1
                cue = next((CUES[w] for w in (x.strip("\"'<[({,;:=!?.>)]}").lower() for x in reversed(words[max(0, i - 2) : i])) if w in CUES), "none")
                f = span_features(text[a:b], cue, j - i + 1)
                if f:
                    self.ends[j].append((i, a, b, f))


def _score(w: dict, kind: str, feats: tuple[str, ...]) -> float:
    return sum(w.get((kind, f), 0.0) for f in feats) + w.get((kind, "bias"), 0.0)


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


OUTSIDE = "outside"


def _after(w: dict, kind: str, before: str) -> float:
    return w.get((kind, f"after:{before}"), 0.0)


def decode(window: Window, w: dict, margin: float) -> list[tuple[str, int, int]]:
    """The best segmentation: tokens outside score 0, a segment its score and that of what it follows, less ``margin``.

    ``best[j]`` has, for each label that can end before token j, the best score and how it came about.
    """
    best: list[dict[str, tuple[float, tuple | None]]] = [{OUTSIDE: (0.0, None)}]
    for j in range(window.n):
        label = max(best[j], key=lambda p: best[j][p][0])
        now = {OUTSIDE: (best[j][label][0], (j, label, None))}
        for i, a, b, f in window.ends[j]:
            for kind in KINDS:
                own = _score(w, kind, f) - margin
                for before, (s, _) in best[i].items():
                    total = s + own + _after(w, kind, before)
                    if kind not in now or total > now[kind][0]:
                        now[kind] = total, (i, before, (kind, a, b))
        best.append(now)
    out, j = [], window.n
    label = max(best[j], key=lambda p: best[j][p][0])
    while j > 0:
        j, label, span = best[j][label][1]
        if span:
            out.append(span)
    return out[::-1]


def gradient(window: Window, gold: set[tuple[str, int, int]], w: dict) -> dict:
    """Features of the labelled segmentation less their expectation under the field."""
    alpha: list[dict[str, float]] = [{OUTSIDE: 0.0}]
    scored = []
    for j in range(window.n):
        own = [(i, kind, a, b, f, _score(w, kind, f)) for i, a, b, f in window.ends[j] for kind in KINDS]
        scored.append(own)
        ways: dict[str, list[float]] = {OUTSIDE: list(alpha[j].values())}
        for i, kind, *_, s in own:
            ways.setdefault(kind, []).extend(x + s + _after(w, kind, before) for before, x in alpha[i].items())
        alpha.append({label: _logsum(x) for label, x in ways.items()})
    whole = _logsum(list(alpha[-1].values()))
    follow: list[list[tuple[int, str, float]]] = [[] for _ in range(window.n + 1)]
    for j, own in enumerate(scored):
        for i, kind, *_, s in own:
            follow[i].append((j + 1, kind, s))
    beta: list[dict[str, float]] = [{} for _ in range(window.n + 1)]
    beta[-1] = dict.fromkeys(alpha[-1], 0.0)
    for i in range(window.n - 1, -1, -1):
        beta[i] = {before: _logsum([beta[i + 1][OUTSIDE], *(s + _after(w, kind, before) + beta[j][kind] for j, kind, s in follow[i])]) for before in alpha[i]}
    end_of = {b: kind for kind, _, b in gold}
    out: dict = {}
    for j, own in enumerate(scored):
        for i, kind, a, b, f, s in own:
            labelled = (kind, a, b) in gold
            before_gold = end_of.get(window.reach[i], OUTSIDE)
            total = 0.0
            for before, x in alpha[i].items():
                p = math.exp(min(0.0, x + s + _after(w, kind, before) + beta[j + 1][kind] - whole))
                total += p
                g = (labelled and before == before_gold) - p
                if abs(g) > 1e-6:
                    out[kind, f"after:{before}"] = out.get((kind, f"after:{before}"), 0.0) + g
            g = labelled - total
            if abs(g) > 1e-6:
                for x in (*f, "bias"):
                    out[kind, x] = out.get((kind, x), 0.0) + g
    return out


# --- labelled windows -----------------------------------------------------------------------


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _card(rng: random.Random, good: bool) -> str:
    body = rng.choice("3456") + _number(rng, rng.choice((13, 14, 14, 14, 14)))
    check = next(c for c in "0123456789" if luhn(body + c))
    digits = body + (check if good else str((int(check) + rng.randint(1, 9)) % 10))
    if rng.random() < 0.6 and len(digits) == 16:
        return rng.choice((" ", "-", ".", "/")).join(digits[i : i + 4] for i in range(0, 16, 4))
    return digits


def _example(rng: random.Random, kind: str | None) -> tuple[str, str]:
    """(cue, value) of a kind in a usual or unusual form, or of a number that is none."""
    cue = ""
    if kind == "email":
        at, dot = rng.choice((("@", "."), ("(at)", "."), ("[at]", "[dot]"), ("@", ".")))
        value = f"{rng.choice('abcdefg')}{_number(rng, 2)}{at}mail{rng.randint(1, 99)}{dot}example{dot}{rng.choice(('com', 'org', 'net'))}"
    elif kind == "ip":
        value = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        value = _card(rng, True)
    elif kind == "phone":
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        form = rng.choice(("+1 ({}) {}-{}", "+1 {}-{}-{}", "+1 {} {} {}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}"))
        value = form.format(a, b, c)
        cue = rng.choice(("tel", "phone", "call")) if "+" not in form and "(" not in form else ""
    else:
        value = rng.choice((
            lambda: _number(rng, rng.randint(7, 19)), lambda: _card(rng, False), lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
            lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{_number(rng, 4)} {_number(rng, 4)}", lambda: f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 4)}",
            lambda: f"{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 3)}", lambda: f"{_number(rng, 3)}.{_number(rng, 3)}.{_number(rng, 4)}", lambda: f"{_number(rng, 5)}-{_number(rng, 5)}",
        ))()
    if not cue and kind and rng.random() < 0.25:
        cue = rng.choice([c for c, x in CUES.items() if x == kind])
    return cue, value


def labelled_windows(cfg: FieldConfig, seed: int) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Generated texts with their spans: all kinds, numbers that are none, and every fifth time two in a row."""
    rng = random.Random(seed)
    plain = "the and of with see page at is in was from order total about on".split()
    out = []
    for k in range(cfg.windows):
        text, gold = " ".join(rng.choice(plain) for _ in range(rng.randint(1, 3))) + " ", set()
        for n in range(2 if k % 5 == 4 else 1):
            kind = (*KINDS, None, None)[(k + n * rng.randint(1, 5)) % 6]
            cue, value = _example(rng, kind)
            text += cue + rng.choice((" ", ": ")) if cue else ""
            if kind:
                gold.add((kind, len(text), len(text) + len(value)))
            text += value + rng.choice(("", ".", ",")) + " "
        out.append((text + rng.choice(plain), gold))
    return out


def _windows(text: str, cfg: FieldConfig):
    """Windows of tokens around anchors: two tokens of context before, gaps of one token at most."""
    tokens: list[tuple[int, int]] = []
    recent: list[tuple[int, int]] = []
    gap = 0
    for m in TOKEN.finditer(text):
        span = m.span()
        if ANCHOR.search(text, *span):
            if not tokens:
                tokens = recent[-2:]
            tokens.append(span)
            gap = 0
        elif tokens:
            gap += 1
            tokens.append(span)
            if gap > 2:
                yield Window(text, tokens, cfg.max_tokens, cfg.max_chars)
                tokens = []
        recent = [*recent[-1:], span]
        if len(tokens) >= 512:  # a long run of numbers goes on in a new window, with a segment's length in common
            yield Window(text, tokens, cfg.max_tokens, cfg.max_chars)
            tokens = tokens[-cfg.max_tokens :]
    if tokens:
        yield Window(text, tokens, cfg.max_tokens, cfg.max_chars)


@functools.lru_cache(maxsize=4)
def fit_field(cfg: FieldConfig) -> tuple[tuple[tuple[str, str], float], ...]:
    """Weights by stochastic gradient ascent; the same for the same parameters."""
    data = [(w, gold) for text, gold in labelled_windows(cfg, cfg.seed) for w in _windows(text, cfg)]
    weights: dict = {}
    rng = random.Random(cfg.seed)
    for epoch in range(cfg.epochs):
        rng.shuffle(data)
        step = cfg.rate / (1 + 0.2 * epoch)
        for window, gold in data:
            for k, g in gradient(window, gold, weights).items():
                weights[k] = weights.get(k, 0.0) * (1 - cfg.decay) + step * g
    return tuple(weights.items())


def all_spans(text: str, weights: dict, cfg: FieldConfig) -> list[tuple[str, int, int, bool]]:
    """Base spans and those that the field adds beside them, by start, then kind."""
    if not ANCHOR.search(text):
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(k, a, b, True) for k, a, b in base]
    starts = [a for a, _ in taken]
    reach: list[int] = []  # furthest end of the base spans so far
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    added: list[tuple[str, int, int]] = []
    for window in _windows(text, cfg):
        for kind, a, b in decode(window, weights, cfg.margin):
            k = bisect.bisect_left(starts, b) - 1
            if (k < 0 or reach[k] <= a) and (not added or added[-1][2] <= a):
                added.append((kind, a, b))
    out += [(k, a, b, False) for k, a, b in added]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_pii(docs: DataFrame, cfg: FieldConfig | None = None, into: str = "_pii") -> DataFrame:
    """``docs`` with ``into``: an array of (kind, start, end, base), in code points, end exclusive.

    Every whole text is read; a null or empty text has no spans. Base spans
    are those of the fixed patterns, the others come from the field and never
    overlap them. Other columns stay as they are; repeated rows stay repeated.
    """
    cfg = cfg or FieldConfig()
    fitted = docs.sparkSession.sparkContext.broadcast(dict(fit_field(cfg)))  # some hundred weights

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        weights = fitted.value
        rows = [[{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in all_spans(t, weights, cfg)] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))

    return docs.withColumn(into, spans.asNondeterministic()("text"))


def redact(docs: DataFrame, cfg: FieldConfig | None = None) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Overlapping spans become one, of the first one's kind. ``n_chars``, where
    present, is counted anew. Null texts stay null; other columns stay,
    whatever their names.
    """
    docs, moved = set_aside(docs, "_pii")
    cols = docs.columns
    cut = F.aggregate(
        "_pii",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
    )
    clean = F.when(F.size("_pii") > 0, F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text")))).otherwise(F.col("text"))
    out = find_pii(docs, cfg).withColumn("text", clean)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.size("_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in cols]).withColumnsRenamed({v: k for k, v in moved.items()})


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every row of ``documents``."""
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("_pii", lambda x: x["base"])
    return out.select(
        "doc_id",
        *[count_kind(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_pii")).alias("spans"),
    )
