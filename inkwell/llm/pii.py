"""Personal data by a semi-Markov conditional random field.

Candidate segments of up to ``LONGEST`` tokens are scored as wholes by features
of their text and surroundings; dynamic programming over segmentations chooses
boundaries and types jointly.  The weights maximise the conditional likelihood,
by forward-backward sums over all segmentations, of invented sentences.  A
segment holds a digit or an at sign, or is what a secret's name is given as in
``password = letters``; it lies in one line, and has spaces only among digits;
so a text falls into blocks that are segmented one by one.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "card", "ip", "secret", "id_number", "iban")
LONGEST = 18
SENTENCES, EPOCHS, SEED = 250, 40, 5

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]")
_EMAIL = re.compile(r"[\w.+%-]*\w@\w[\w-]*(\.[\w-]*\w)+")
_PHONE = re.compile(r"(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)|\d{2,4})([ .-]?\d{2,4}){2,4}")
_IP = re.compile(r"\d{1,3}(\.\d{1,3}){3}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_GROUPS = re.compile(r"\d{4}([ -]\d{4}){2,3}([ -]\d{1,4})?|\d{12,19}")
_ID = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,4})?")
_NAMED = re.compile(r"(?:password|passwd|pwd|passphrase|secret|token|api_?key|credential)\w{0,8}[\"']?\s{0,2}[:=]\s{0,2}[\"']?(?=\w)", re.I)
_NAME = re.compile(r"(?:password|passwd|pwd|passphrase|secret|token|api_?key|credential)\w{0,8}[\"']?\s{0,2}([:=])\s{0,2}([\"']?)$", re.I)
_CUE = re.compile(r"(token|key|secret|password|passwd|credential|auth)\W{0,6}$", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def features(text: str, start: int, end: int, tokens: int) -> list[float]:
    """Of the whole span text[start:end] and what is next to it."""
    s = text[start:end]
    left, right, after = text[start - 1 : start], text[end : end + 1], text[end + 1 : end + 2]
    digits = sum(c.isdigit() for c in s)
    grouped, phone, ip, hexa = _GROUPS.fullmatch(s), _PHONE.fullmatch(s), _IP.fullmatch(s), _HEX.fullmatch(s)
    bare = re.sub(r"[ -]", "", s) if grouped else ""
    letters = any(c.isalpha() for c in s)
    named = _NAME.search(text[max(0, start - 40) : start])
    whole = not (right.isalnum() or right in "-_.@" and after.isalnum())
    email = _EMAIL.fullmatch(s)
    return [
        1.0,
        float(s.count("@") == 1),
        float(bool(email)),
        float(bool(email) and tokens >= 5),
        float(any(c.isspace() for c in s)),
        float(bool(grouped)),
        float(len(bare) == 16),
        float(bool(grouped) and 13 <= len(bare) <= 19 and _luhn(bare)),
        float(bool(phone) and not grouped),
        float(bool(phone) and 9 <= digits <= 13),
        float(s[0] == "+"),
        float("(" in s and ")" in s),
        float(bool(phone) and tokens > 2),
        float(bool(ip)),
        float(bool(ip) and all(int(x) < 256 for x in s.split("."))),
        float(bool(hexa) and len(s) >= 24 and letters and digits > 2),
        float(bool(hexa) and len(s) in (32, 40, 64) and letters),
        float(tokens == 1 and len(s) >= 16 and letters and digits > 1),
        float(bool(_CUE.search(text[max(0, start - 24) : start]))),
        float(bool(named)),
        float(bool(named) and whole and len(s) >= 6 and not s.isdigit()),
        float(bool(named) and named[1] == "="),
        float(bool(named) and named[2] != ""),
        float(bool(named) and named[1] == ":" and named[2] == "" and s.isalpha()),
        float(bool(_ID.fullmatch(s))),
        float(bool(_IBAN.fullmatch(s)) and letters),
        float(bool(_IBAN.fullmatch(s)) and 15 <= len(s.replace(" ", "")) <= 34 and letters and digits >= 8),
        float(left.isalnum() or (left in ".@+-_(" and left != "" and s[0].isalnum() and text[start - 2 : start - 1].isalnum()) or left in ("+", "@")),
        float(right.isalnum() or (right in ".@-_" and right != "" and after.isalnum()) or right == "@"),
        float(not (s[0].isalnum() or s[0] in "+(") or not (s[-1].isalnum() or s[-1] == ")")),
        float(digits < 7 and not email),
        min(tokens, LONGEST) / LONGEST,
    ]


_SIZE = len(features("0", 0, 1, 1))


def _linked(text: str, tokens: list[tuple[int, int]]) -> list[bool]:
    """Whether an entity can hold token k and the one before: no space between, or one among digits."""
    out = [False] * len(tokens)
    for k in range(1, len(tokens)):
        (a, b), (c, d) = tokens[k - 1], tokens[k]
        if b == c:
            out[k] = True
        elif c - b == 1:
            before, after = text[b - 1], text[c]
            out[k] = (before.isdigit() or before in ")+" or text[b - 2 : b].isupper()) and (after.isdigit() or after == "(" or text[d - 1].isdigit()) and text[b] != "\n"
    return out


def _given(text: str) -> set[int]:
    """Where in a line what a secret's name is given begins."""
    return {m.end() for m in _NAMED.finditer(text)}


def blocks(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of linked tokens that hold a digit, an at sign or what a secret's name is given."""
    linked, out, i, named = _linked(text, tokens), [], 0, _given(text)
    for j in range(1, len(tokens) + 1):
        if j == len(tokens) or not linked[j]:
            if _TRIGGER.search(text, tokens[i][0], tokens[j - 1][1]) or any(tokens[i][0] <= a < tokens[j - 1][1] for a in named):
                out.append((i, j))
            i = j
    return out


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate segments (first, last+1): linked tokens with a digit or an at sign, or from where a secret's name is given something; from a letter, digit, + or ( to a letter, digit or )."""
    out, named = [], _given(text)
    for first, last in blocks(text, tokens):
        has = [0]
        for a, b in tokens[first:last]:
            has.append(has[-1] + bool(_TRIGGER.search(text, a, b)))
        begins = [text[a].isalnum() or text[a] in "+(" for a, _ in tokens[first:last]]
        for j in range(first + 1, last + 1):
            end = text[tokens[j - 1][1] - 1]
            if end.isalnum() or end == ")":
                out += [(i, j) for i in range(max(first, j - LONGEST), j) if begins[i - first] and (has[j - first] > has[i - first] or tokens[i][0] in named)]
    return out


def _matrix(text: str, tokens, spans) -> np.ndarray:
    return np.array([features(text, tokens[i][0], tokens[j - 1][1], j - i) for i, j in spans], np.float64).reshape(len(spans), _SIZE)


def _by_end(spans: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list = [([], []) for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        out[j][0].append(k)
        out[j][1].append(i)
    return [(np.array(a, int), np.array(b, int)) for a, b in out]


def _sum(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log(np.exp(x - top).sum()))


def marginals(scores: np.ndarray, spans: list[tuple[int, int]], n: int) -> tuple[float, np.ndarray]:
    """Log-partition over all segmentations of n tokens, and each segment's and type's probability."""
    ends = _by_end(spans, n)
    best = np.array([_sum(s) for s in scores]) if len(spans) else np.zeros(0)
    alpha = np.zeros(n + 1)
    for j in range(1, n + 1):
        k, i = ends[j]
        alpha[j] = _sum(np.r_[alpha[j - 1], alpha[i] + best[k]])
    beta = np.zeros(n + 1)
    starts: list = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        starts[i].append((k, j))
    for i in range(n - 1, -1, -1):
        ks, js = [k for k, _ in starts[i]], [j for _, j in starts[i]]
        beta[i] = _sum(np.r_[beta[i + 1], best[ks] + beta[js]])
    i, j = (np.array(x, int) for x in zip(*spans)) if spans else (np.zeros(0, int),) * 2
    return alpha[n], np.exp(scores + (alpha[i] + beta[j] - alpha[n])[:, None])


def decoded(scores: np.ndarray, spans: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first, last+1, type); of equal ones the one with fewer tokens in entities."""
    ends, top = _by_end(spans, n), scores.max(1) if len(spans) else np.zeros(0)
    value, back = np.zeros(n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        k, i = ends[j]
        if len(k):
            total = value[i] + top[k]
            m = int(total.argmax())
            if total[m] > value[j]:
                value[j], back[j] = total[m], int(k[m])
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            i, _ = spans[back[j]]
            out.append((i, j, int(scores[back[j]].argmax())))
            j = i
    return out[::-1]


def invented(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with entities (start, end, type) and with numbers that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorstdlumé") for _ in range(r.randint(1, 9)))
    host = lambda: ".".join(word() + r.choice(["", digits(1)]) for _ in range(r.randint(1, 2))) + "." + r.choice(["com", "org", "net", "de", "io"])
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(r.randint(6, 16)))
    name = lambda: r.choice(["password", "passwd", "pwd", "secret", "db_password", "token"])

    def entity(kind: str) -> str:
        if kind == "email":
            return r.choice([f"{word()}.{digits(2)}", word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}+{word()}"]) + "@" + host()
        if kind == "phone":
            sep = r.choice(" .-")
            return r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}"])
        if kind == "card":
            return r.choice([digits(16), digits(16), digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), digits(15)])
        if kind == "ip":
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "secret":
            s = hexa(r.choice([32, 40, 40, 40, 64]))
            return s.upper() if r.random() < 0.3 else s
        if kind == "id_number":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        body = digits(r.randint(14, 20))
        s = r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + body
        return s if r.random() < 0.6 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def other() -> str:
        return r.choice([digits(r.randint(1, 8)), f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}.", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}%", f"${digits(3)}.{digits(2)}", f"{word()}{digits(2)}", f"{digits(3)},{digits(3)}", f"{word()} @ {word()}", "@" + word(), f"({digits(4)})", f"{digits(2)}-{digits(2)}", "No. " + digits(3), f"{digits(1)}/{digits(1)}", f"{name()}: {word()} {word()}", f"the {name()} of {word()}", f"{name()} = {digits(2)}", f"{name()}: {word()}"])

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(2, 4)):
            text += "".join(word() + " " for _ in range(r.randint(1, 3)))
            if r.random() < 0.72:
                k = r.randrange(len(KINDS))
                s = entity(KINDS[k])
                if KINDS[k] == "secret" and r.random() < 0.7:
                    text += r.choice(['token = "', "key: ", 'secret="', "api_key = "])
                if KINDS[k] == "secret" and r.random() < 0.3:
                    s = letters() + r.choice(["", "", "-" + letters(), digits(2)])
                    text += name() + r.choice([" = ", "=", ' = "', '="', ': "', "='"])
                gold.append((len(text), len(text) + len(s), k))
                text += s + r.choice(["", "", ".", ",", '"', "###", "!!", "%%%", "$$$", ")"])
            else:
                text += other()
            text += r.choice([" ", " ", " | "])
        text += word()
        out.append((text.upper() if r.random() < 0.05 else text, gold))
    return out


@functools.cache
def trained(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """[type, feature] weights: the largest conditional likelihood, with a Gaussian prior."""
    data = []
    for text, gold in invented(sentences, seed):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        spans = segments(text, tokens)
        place = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j) in enumerate(spans)}
        if not spans or any((a, b) not in place for a, b, _ in gold):
            continue
        target = np.zeros((len(spans), len(KINDS)))
        for a, b, k in gold:
            target[place[a, b], k] = 1
        data.append((_matrix(text, tokens, spans), spans, len(tokens), target))
    w, m, v = (np.zeros((len(KINDS), _SIZE)) for _ in range(3))
    for t in range(1, epochs + 1):
        g = -0.02 * w
        for x, spans, n, target in data:
            g += (target - marginals(x @ w.T, spans, n)[1]).T @ x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.6 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def entities(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type) of a text's entities."""
    out, at = [], 0
    if not (_TRIGGER.search(text) or _NAMED.search(text)):
        return out
    for line in text.split("\n"):
        if _TRIGGER.search(line) or _NAMED.search(line):
            tokens = [m.span() for m in _TOKEN.finditer(line)]
            for i, j in blocks(line, tokens):  # no segment crosses a block's ends
                part = tokens[i:j]
                spans = segments(line, part)
                scores = _matrix(line, part, spans) @ weights.T
                out += [(at + part[a][0], at + part[b - 1][1], k) for a, b, k in decoded(scores, spans, len(part))]
        at += len(line) + 1
    return out


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value) of every entity; offsets count characters from 0.

    Null and empty texts have none; repeated rows have theirs each; an empty
    table gives an empty result.  Entities of a document don't overlap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for k, t in enumerate(b.column(1)):
                t = t.as_py()
                for start, end, kind in entities(t, shared.value) if t else ():
                    rows.append(k)
                    found.append((KINDS[kind], start, end, t[start:end]))
            if rows:
                cols = [pa.array(list(c), p) for c, p in zip(zip(*found), (pa.string(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *cols], names=["doc_id", "kind", "start", "end", "value"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, kind string, start int, end int, value string")
