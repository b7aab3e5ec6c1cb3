"""Personal data: exact patterns, and a character BiLSTM-CRF for what they miss.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers (see
`pattern_spans`); each kind is matched by itself, leftmost and without overlap.

The tagger is trained on labelled spans: those of `labelled_lines`, which writes all
kinds in the usual ways into made-up prose, beside numbers of other kinds, and those that
the patterns (and the plainest form of a secret) find in a bounded sample of the texts
themselves, as they stand and with the marks altered that patterns rely on (`altered`), so
that it learns the kinds in the prose at hand. It adds what patterns miss: the four kinds in other spellings, and
secrets (tokens, keys and passwords).

It reads windows of WINDOW characters that overlap by LAP. Where windows overlap, their
scores are averaged, each weighed by the distance from its edge, and one path
through tags and moves is sought over the whole run of windows, so seams are decided like
any other place. Runs of a tag are spans. A span must hold what its kind cannot be without
(see `plausible`) and must not overlap a pattern's span. As every kind needs a digit, `@`,
`(` or `[`, only windows near such a character can bring a span, and only those are read.

Null text is empty and has no span; text of any length is read whole. Positions count
code points, ends are exclusive. Repeated rows get equal results, and are drawn once for
training. An empty table gives an empty result. Other columns are ignored, or carried along
by `redacted`.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftline.llm.arrowtext import flat, release
from weftline.llm.tagger import Tagger, encode
from weftline.runtime import small_batches

KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")
WINDOW, LAP, REACH = 96, 32, 40
TRAIN_LINES, STEPS, SEED = 2500, 400, 9
FIT_TEXTS, FIT_SPANS = 20_000, 2  # texts that the sample draws, and spans that it takes of each
DECODED = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN, _TOKEN_LEFT, LONGEST_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]*"), re.compile(r"[A-Za-z0-9_+/-]*\Z"), 512
_SECRET = re.compile(r"(?i)\b(?:token|api_?key|secret|password)\w* ?[:=] ?[\"']([A-Za-z0-9_+/=-]{16,80})[\"']")  # the plainest form, to learn others from
_AROUND = " \t\n.,;:!?"
_TRIGGER = np.array([chr(b) in "0123456789@([" for b in range(256)])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @ in turn."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def plausible(kind: str, text: str) -> bool:
    d = _digits(text)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+", text, re.I))
    if kind == "ip":
        groups = re.findall(r"[0-9]+", text)
        return len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups) and len(d) >= 6 and len(text) <= 27
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9_./+=-]{8,}", text)) and bool(d) and bool(re.search("[A-Za-z]", text))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"\(?[0-9]{1,4}\)?(?:[ .-]?\(?[0-9]{2,5}\)?){2,4}", text)) and bool(re.search(r"[ ().-]", text))


def labelled_lines(n: int = TRAIN_LINES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up lines with the spans of each kind that stand in them."""
    rng = random.Random(seed)
    pick, num = rng.choice, rng.randint
    parts = "an the re ti on ea sh wh ou er st nd ing tion ly le be ent ion al de un ver sch ge mo ra qui".split()
    word = lambda: "".join(pick(parts) for _ in range(num(1, 3)))
    digits = lambda k: "".join(str(num(0, 9)) for _ in range(k))

    def card() -> str:
        d = pick("3456") + digits(14)
        d += str(next(c for c in range(10) if luhn(d + str(c))))
        sep = pick(["", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = pick([("@", "."), ("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
        return word() + pick(["", ".", "_"]) + pick([word(), digits(2), ""]).replace(".", "") + at + word() + pick(["", digits(1)]) + dot + pick(["com", "org", "net", "example.com" if dot == "." else "de"])

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{num(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(1, 99)} {a} {b} {c}", f"0{digits(2)} {digits(4)} {c}", f"1-{a}-{b}-{c}"])

    def secret() -> tuple[str, str, str]:
        name = pick(["token", "api_key", "apikey", "secret", "password", "passwd", "access_token", "client_secret", "auth", "TOKEN", "API_KEY"])
        mark = pick([" = ", "=", ": ", " is ", " := "])
        quote = pick(['"', '"', "'", ""])
        marks = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        body = pick([lambda: f"{rng.getrandbits(160):040x}", lambda: f"{rng.getrandbits(128):032x}", lambda: "".join(pick(marks) for _ in range(num(12, 40))) + digits(1), lambda: pick(["sk_", "ghp_", "AKIA"]) + "".join(pick(marks) for _ in range(num(16, 30))) + digits(1)])()
        return name + mark + quote, body, quote

    make = {"email": email, "ip": lambda: pick([".", ".", "[.]", " . "]).join(str(num(1, 255)) for _ in range(4)), "card": card, "phone": phone}
    other = [
        lambda: str(num(0, 99999)), lambda: f"{num(1, 28)}.{num(1, 12)}.{num(1990, 2030)}", lambda: f"{num(2000, 2030)}-{num(10, 12)}-{num(10, 28)}", lambda: f"{num(0, 23)}:{num(10, 59)}",
        lambda: f"v{num(0, 9)}.{num(0, 20)}", lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: "%x" % rng.getrandbits(160), lambda: f"({word()})", lambda: f"[{num(1, 99)}]", lambda: f"{num(1, 9)}%", lambda: f"@{word()}", lambda: f"{rng.getrandbits(160):040x}", lambda: f"{word()} = {digits(5)}", lambda: digits(16), lambda: f'"{word()}{digits(2)}"',
    ]
    lines = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(num(4, 14)):
            text += pick(["", "", " ", "\n"]) if text else ""
            if text and not text[-1].isspace():
                text += " "
            roll = rng.random()
            if roll < 0.16:
                kind = pick(TAGGED)
                before, body, after = secret() if kind == "secret" else ("", make[kind](), "")
                text += before
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + after + pick(["", "", "", ",", ".", "###", "!!"])
            elif roll < 0.3:
                text += pick(other)()
            else:
                text += word() + pick(["", "", "", ",", "."])
        lines.append((text, spans))
    return lines


def altered(kind: str, body: str, rng: random.Random) -> str:
    """A pattern's span in a spelling that the pattern does not know; a secret has no other."""
    if kind == "secret":
        return body
    if kind == "email":
        at, dot = rng.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", ".")])
        name, host = body.rsplit("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return body.replace(".", rng.choice(["[.]", "(.)", " . "]))
    if kind == "card":
        d = _digits(body)
        return rng.choice([".", " - ", "/"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    return rng.choice([lambda: body[1:], lambda: body[body.index(" ") + 1 :] if " " in body else body[1:], lambda: "-".join(re.findall("[0-9]+", body))])()


def snippets(text: str, most: int = FIT_SPANS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Stretches of a window's length with the patterns' spans in them, around `most` spans that the text itself picks."""
    spans = sorted([*pattern_spans(text), *(("secret", *m.span(1)) for m in _SECRET.finditer(text))], key=lambda s: s[1:])
    if not spans:
        return []
    rng = random.Random(len(text) * 31 + spans[0][1])
    out = []
    for kind, a, b in rng.sample(spans, min(most, len(spans))):
        start = max(0, a - rng.randint(8, 40))
        own = [(k, x - start, y - start) for k, x, y in spans if start <= x and y <= start + WINDOW]
        if own and len({x for _, x, _ in own}) == len(own):
            out.append((text[start : start + WINDOW], own))
    return out


def alter_lines(lines: list[tuple[str, list[tuple[str, int, int]]]], seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The lines with each span in another spelling."""
    rng, out = random.Random(seed), []
    for text, spans in lines:
        body, free, moved = "", 0, []
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            if a < free:
                continue
            new = altered(kind, text[a:b], rng)
            body += text[free:a]
            moved.append((kind, len(body), len(body) + len(new)))
            body, free = body + new, b
        out.append((body + text[free:], moved))
    return out


def sampled_lines(docs: DataFrame, texts: int = FIT_TEXTS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """snippets() of about `texts` texts of docs(text), drawn by hash, equal ones once."""
    total = max(1, docs.count())

    @arrow_udf("array<string>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([[json.dumps(x) for x in snippets(t or "")] for t in column.to_pylist()], pa.list_(pa.string()))

    drawn = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < min(1.0, texts / total) * (1 << 20))
    rows = drawn.select(F.explode(of(F.col("text"))).alias("x")).distinct().collect()  # FIT_SPANS of each text drawn at most
    return [(t, [tuple(s) for s in spans]) for t, spans in map(json.loads, sorted(r[0] for r in rows))]


def fit(docs: DataFrame) -> Tagger:
    """A tagger for docs(text): from made-up lines and from what the patterns find in a sample of its texts."""
    small_batches(docs.sparkSession)
    own = sampled_lines(docs)
    return train(labelled_lines() + own + alter_lines(own) + alter_lines(own, SEED + 1))


def train(lines: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS) -> Tagger:
    """A tagger from labelled spans."""
    ids, gold = np.zeros((len(lines), WINDOW), np.int64), np.zeros((len(lines), WINDOW), np.int64)
    for row, (text, spans) in enumerate(lines):
        points = encode(np.frombuffer(text.encode("utf-32-le"), np.uint32))[:WINDOW]
        ids[row, : len(points)] = points
        for kind, a, b in spans:
            gold[row, a : min(b, WINDOW)] = 1 + TAGGED.index(kind)
    tagger = Tagger(1 + len(TAGGED))
    tagger.train(ids, gold, steps)
    return tagger


@cache
def default_tagger() -> Tagger:
    return train(labelled_lines())


def _windows(points: np.ndarray, triggers: np.ndarray) -> list[int]:
    """Starts of the windows of a text that hold a trigger or stand near one."""
    hop, need = WINDOW - LAP, np.zeros(len(points) // (WINDOW - LAP) + 2, dtype=bool)
    for shift in (-REACH, 0, REACH):
        need[np.clip(triggers + shift, 0, len(points) - 1) // hop] = True
    return (np.flatnonzero(need) * hop).tolist()


def _runs(starts: list[int], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, window starts) of windows that overlap in a row."""
    held: list[int] = []
    for start in starts:
        if held and start > held[-1] + WINDOW - LAP:
            yield held[0], min(held[-1] + WINDOW, size), held
            held = []
        held.append(start)
    if held:
        yield held[0], min(held[-1] + WINDOW, size), held


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger in each text, plausible for their kind."""
    rows: list[np.ndarray] = []
    runs: list[tuple[int, int, int, int, list[int]]] = []  # text, start, end, first window's row, window starts
    for n, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        triggers = np.flatnonzero(_TRIGGER[np.minimum(points, 255)])
        if not len(triggers):
            continue
        symbols = encode(points)
        starts = [s for s in _windows(points, triggers) if s < len(points)]
        for a, b, own in _runs(starts, len(points)):
            runs.append((n, a, b, len(rows), own))
            rows += [np.pad(symbols[s : s + WINDOW], (0, max(0, s + WINDOW - len(symbols)))) for s in own]
    scores: list[np.ndarray] = []
    for a in range(0, len(rows), DECODED):
        scores.extend(tagger.scores(np.stack(rows[a : a + DECODED])))
    trust = 1.0 + np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))[:, None]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    runs.sort(key=lambda r: r[2] - r[1])
    at = 0
    while at < len(runs):
        end = at + 1
        while end < len(runs) and end - at < DECODED and (end + 1 - at) * (runs[end][2] - runs[end][1]) <= DECODED * WINDOW:
            end += 1
        length = runs[end - 1][2] - runs[end - 1][1]
        total, weight = np.zeros((end - at, length, 1 + len(TAGGED)), np.float32), np.zeros((end - at, length, 1), np.float32)
        for k, (_, a, b, first, own) in enumerate(runs[at:end]):
            for i, s in enumerate(own):
                part = slice(s - a, min(s + WINDOW, b) - a)
                size = part.stop - part.start
                total[k, part] += scores[first + i][:size] * trust[:size]
                weight[k, part] += trust[:size]
        tags = tagger.best_path(total / np.maximum(weight, 1), weight[:, :, 0] > 0)
        for (n, a, b, *_), tag in zip(runs[at:end], tags):
            tag = tag[: b - a]
            cut = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1], True])
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if tag[x]:
                    kind, body = TAGGED[int(tag[x]) - 1], texts[n][a + x : a + y]
                    x, y = a + x + len(body) - len(body.lstrip(_AROUND)), a + y - (len(body) - len(body.rstrip(_AROUND)))
                    if kind == "secret":  # the whole of a token, where only part of it was tagged
                        x, y = _TOKEN_LEFT.search(texts[n], max(0, x - LONGEST_TOKEN), x).start() if x else x, _TOKEN.match(texts[n], y).end()
                    if x < y and plausible(kind, texts[n][x:y]):
                        found[n].append((kind, x, y))
        at = end
    return [sorted(set(own), key=lambda s: s[1:]) for own in found]


def find(column: pa.Array, tagger: Tagger) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """(pattern spans, added spans) of each row."""
    at, raw = flat(column)
    marked = np.flatnonzero(_TRIGGER[raw])
    rows = np.unique(np.searchsorted(at, marked, "right") - 1)
    base: list[list] = [[] for _ in range(len(column))]
    added: list[list] = [[] for _ in range(len(column))]
    texts = [raw[at[r] : at[r + 1]].tobytes().decode() for r in rows]
    for r, text, more in zip(rows.tolist(), texts, tagged_spans(texts, tagger)):
        base[r] = pattern_spans(text)
        taken = sorted((a, b) for _, a, b in base[r])
        added[r] = [(k, a, b) for k, a, b in more if not any(x < b and a < y for x, y in taken)]
    release()
    return base, added


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "array<struct<kind: string, start: long, end: long>>"


def _as_rows(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in spans], _SPAN)


def spans_column(text: Column, tagger: Tagger) -> Column:
    """Struct of base and added spans, each by kind as listed and then start."""

    @arrow_udf(f"struct<base: {_SPANS}, added: {_SPANS}>")
    def of(column: pa.Array) -> pa.Array:
        base, added = find(column, tagger)
        order = lambda own: sorted(own, key=lambda s: (TAGGED.index(s[0]), s[1]))
        return pa.StructArray.from_arrays([_as_rows([order(x) for x in base]), _as_rows([order(x) for x in added])], ["base", "added"])

    return of(text)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, base, added) for each row of docs(doc_id, text); without a tagger one is fitted to docs."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", spans_column(F.col("text"), tagger or fit(docs)).alias("x"))
    return found.select("doc_id", "x.base", "x.added")


def redacted(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; null stays null. Without a tagger one is fitted to docs."""
    small_batches(docs.sparkSession)
    tagger = tagger or fit(docs)

    @arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        base, added = find(column, tagger)
        out = column.to_pylist()
        for r, spans in enumerate(x + y for x, y in zip(base, added)):
            text, parts, free = out[r], [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if b <= free:
                    continue
                parts += [text[free : max(a, free)], f"[{kind.upper()}]" if a >= free else ""]
                free = b
            if spans:
                out[r] = "".join(parts) + text[free:]
        return pa.array(out, pa.string())

    return docs.withColumn("text", of(F.col("text")))
