"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small table of labelled sentences that this module makes from rules, and decoded by Viterbi in numpy
batches. Words are what stands between white space. A word can lie in a span only if it is marked (it has a digit, one of
``@ = +`` or the head of a key) or if it is a trigger such as ``token``; any other word is outside by a hard constraint of the
field. Such a word cuts the chain, so runs of marked and trigger words are decoded on their own, with the labels that decoding
the whole text would give. A span must hold a marked word.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filled, prepare

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O",) + tuple(f"{at}-{kind}" for kind in KINDS for at in "BI")

# -- the fixed patterns -------------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start at the first digit of a run: where it fails there, it fails at each later digit of the run too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind, by start and kind."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


# -- word shapes --------------------------------------------------------------------------------------------------------

#: Words that often stand before a secret or a number; fixed values of this module.
TRIGGERS = frozenset("password passwd pwd pass token secret key apikey api_key access_key phone tel mobile call fax email mail card visa ip address host user".split())
_TRIM_LEFT = "([{<\"'`,;:"
_TRIM_RIGHT = ".,;:!?)]}>\"'`*%&$#|"
_CLASS = re.compile(r"(A+)|(a+)|(0+)")
_HEX = re.compile(r"[0-9a-f]{12,}\Z", re.I)


_PAIRS = re.compile(r"(..)\1+")


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, runs shortened to one, everything else as it is but non-ASCII letters as a; in long shapes repeated pairs are shortened too."""
    out, last = [], ""
    for c in word:
        c = "0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c if c < "\x7f" else "_"
        if c != last:
            out.append(c)
            last = c
    whole = "".join(out)
    return whole if len(whole) <= 24 else _PAIRS.sub(r"\1~", whole)


def _bucket(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-13" if n < 14 else "14-19" if n < 20 else "20+"


def features(word: str) -> tuple[str, ...]:
    """The features of one word; no feature holds the word itself, unless it is a trigger."""
    core = word.strip(_TRIM_LEFT).rstrip(_TRIM_RIGHT)
    digits = sum("0" <= c <= "9" for c in core)
    low = core.lower()
    head = re.split(r"[=:]", low)[0] if low else ""
    value = core[len(head) + 1 :].strip("\"'") if len(head) < len(core) else core
    return (
        f"s:{shape(core)}",
        f"d:{_bucket(digits)}",
        f"n:{_bucket(len(core))}",
        f"at:{'@' in core}",
        f"dots:{min(core.count('.'), 4)}",
        f"plus:{core[:1] == '+'}",
        f"eq:{core in ('=', ':', '==') or word == '='}",
        f"trigger:{head.strip('=') in TRIGGERS}",
        f"assign:{len(head) < len(core) and head in TRIGGERS and len(value) >= 6}",
        f"hex:{bool(_HEX.match(value))}",
        f"mixed:{digits >= 2 and len(value) >= 12 and value.isalnum() and not value.isdigit() and not value.islower() | value.istitle()}",
        f"upper:{digits > 0 and len(value) >= 12 and value.isalnum() and value.isupper() or core[:4] == 'AKIA'}",
        f"numeric:{bool(core) and all(c in '0123456789 ().+-' for c in core)}",
        f"open:{core[:1] == '(' or word[:1] == '('}",
        f"ends:{word[-1:] if word[-1:] in ',.:;' else ''}",
    )


_MARK = re.compile(r"[0-9@=+]|AKIA[A-Z]")


def barred(word: str) -> bool:
    """Whether a word is outside whatever stands around it."""
    return not _MARK.search(word) and word.strip(_TRIM_LEFT).rstrip(_TRIM_RIGHT).lower() not in TRIGGERS


# -- the labelled table -------------------------------------------------------------------------------------------------


def labelled_sentences(n: int = 700, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label) made from rules: invented words around personal data, and numbers that are none."""
    r = random.Random(seed)
    syllables = "an er the on ti re in ou le de que la en ch ge st är é ción los ment für ar".split()

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        w = r.choice([w, w, w, w.capitalize(), w.upper()])
        return w + r.choice(["", "", "", "", ",", ".", "***", "%%%", "!!", "###", ":"])

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def name() -> str:
        return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def hexes(k: int) -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(k))

    def upper(k: int) -> str:
        few = r.choice([0.0, 0.1, 0.3])
        return "".join(r.choice("0123456789") if r.random() < few else r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))

    def email() -> list[str]:
        user = name() + r.choice(["", ".", "_", "-", "+"]) + r.choice([name(), digits(2), ""])
        return [f"{user or name()}@{name()}{r.choice(['', digits(1)])}{r.choice(['', '.mail', '.example'])}.{r.choice(['com', 'org', 'de', 'fr', 'net'])}"]

    def ip() -> list[str]:
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def card() -> list[str]:
        d = r.choice("3456") + digits(r.choice([13, 14, 15, 15, 15]))
        return r.choice([[d], [d], [d[i : i + 4] for i in range(0, len(d), 4)], ["-".join(d[i : i + 4] for i in range(0, len(d), 4))]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([[f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"+{r.randint(1, 99)}{a}{b}{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{r.randint(1, 99)}-{a}-{b}-{c}"]])

    def secret() -> list[str]:
        key = r.choice(["password", "token", "secret", "api_key", "pwd", "apikey", "key"])
        value = r.choice([hexes(18), hexes(32), hexes(40), digits(1) + upper(19), name() + digits(4) + upper(6)])
        return r.choice([[f"{key}={value}"], [f"{key}={value}"], [key, "=", f'"{value}"'], [key, "=", f'"{value}"'], [f"{key}:{value}"], [f"{key}:", value], ["AKIA" + upper(16)], ["AKIA" + upper(16)], ["AKIA" + upper(16)]])

    def none() -> list[str]:
        return [r.choice([str(r.randint(0, 2030)), f"v{r.randint(0, 9)}.{r.randint(0, 20)}", f"{r.randint(1, 99)}%", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"${digits(3)}.{digits(2)}", "a=b", "x", "=", "+", "C++", "2.0.", f"{digits(2)}:{digits(2)}", f"#{digits(5)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", "1st", f"p{digits(2)}", f"{digits(3)},{digits(3)}", "@", f"@{name()}", r.choice(sorted(TRIGGERS)), f"({digits(4)})", f"page={digits(2)}", f"{name()}={name()}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}"])]

    makers = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    out = []
    for _ in range(n):
        sentence: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 4)):
            sentence += [(word(), "O") for _ in range(r.randint(0, 4))]
            if r.random() < 0.3:
                for _ in range(r.choice([1, 1, 2, 3])):
                    sentence += [(w, "O") for w in none()]
                sentence += [(word(), "O") for _ in range(r.randint(0, 1))]
            if r.random() < 0.75:
                kind = r.choice(KINDS)
                words = makers[kind]()
                if r.random() < 0.25:
                    words[-1] += r.choice([".", ",", ";", ")"])
                sentence += [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words)]
                if r.random() < 0.55:  # else the next one follows at once
                    sentence += [(word(), "O")]
            if r.random() < 0.25:
                sentence += [(r.choice(sorted(TRIGGERS)), "O"), (word(), "O")]
        sentence += [(word(), "O")]
        out.append(sentence)
    return out


# -- training and decoding ----------------------------------------------------------------------------------------------


class Field:
    """A trained conditional random field. Emissions of a word are sums over its own features and those of both neighbours."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.index, self.weights, self.transitions = index, weights, transitions
        self.known: dict[str, np.ndarray] = {}

    def parts(self, word: str) -> np.ndarray:
        """(3, labels): what a word adds to the scores of the word itself, of the next one and of the one before."""
        if word not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            rows = [self.index[f] for f in features(word) if f in self.index]
            self.known[word] = self.weights[rows].sum(axis=0) if rows else np.zeros(self.weights.shape[1:])
            if barred(word):
                self.known[word][0, 1:] -= 1e4
        return self.known[word]

    def decode(self, segments: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each segment. Its first and last word only give context and are outside."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(segments)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(i)
        t = self.transitions
        for n, members in by_length.items():
            for at in range(0, len(members), 4096):
                own = members[at : at + 4096]
                p = np.array([[self.parts(w) for w in segments[i]] for i in own])  # (batch, n, 3, labels)
                e = p[:, 1:-1, 0] + p[:, :-2, 1] + p[:, 2:, 2]
                best = t[0] + e[:, 0]
                back = np.zeros((len(own), n - 2, e.shape[2]), dtype=np.int64)
                for k in range(1, n - 2):
                    scores = best[:, :, None] + t
                    back[:, k] = scores.argmax(axis=1)
                    best = scores.max(axis=1) + e[:, k]
                label = (best + t[:, 0]).argmax(axis=1)
                path = np.zeros((len(own), n - 2), dtype=np.int64)
                for k in range(n - 3, -1, -1):
                    path[:, k] = label
                    label = back[np.arange(len(own)), k, label]
                for i, labels in zip(own, path, strict=True):
                    out[i] = labels
        return out


def train(sentences: list[list[tuple[str, str]]], rounds: int = 60, rate: float = 0.2, l2: float = 2e-4) -> Field:
    """Maximum likelihood by Adam; gradients by forward and backward sums over a padded batch."""
    names = sorted({f for s in sentences for w, _ in s for f in features(w)})
    index = {f: i for i, f in enumerate(names)}
    words = sorted({w for s in sentences for w, _ in s})
    number = {w: i for i, w in enumerate(words)}
    has = np.zeros((len(words) + 1, len(names)))  # the last row is the padding around sentences
    for w, i in number.items():
        has[i, [index[f] for f in features(w)]] = 1
    k, n, size = len(LABELS), len(sentences), max(map(len, sentences))
    label = {name: i for i, name in enumerate(LABELS)}
    x = np.full((n, size + 2), len(words))
    y = np.zeros((n, size), dtype=np.int64)
    mask = np.zeros((n, size))
    for i, s in enumerate(sentences):
        for j, (w, at) in enumerate(s):
            x[i, j + 1], y[i, j], mask[i, j] = number[w], label[at], 1
    last = mask.sum(axis=1).astype(int) - 1
    onehot = np.eye(k)[y] * mask[..., None]
    both = mask[:, 1:] * mask[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1][both > 0], y[:, 1:][both > 0]), 1)
    np.add.at(seen[0], y[:, 0], 1)
    np.add.at(seen[:, 0], y[np.arange(n), last], 1)
    w, t = np.zeros((len(names), 3 * k)), np.zeros((k, k))
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t)]
    for step in range(1, rounds + 1):
        p = (has @ w).reshape(-1, 3, k)
        e = p[x[:, 1:-1], 0] + p[x[:, :-2], 1] + p[x[:, 2:], 2]
        # Sums in the probability domain, scaled at each position.
        top = e.max(axis=2, keepdims=True)
        local, move = np.exp(e - top), np.exp(t)
        a, b, scale = np.empty((n, size, k)), np.empty((n, size, k)), np.ones((n, size))
        for j in range(size):
            a[:, j] = (move[0] if j == 0 else a[:, j - 1] @ move) * local[:, j]
            scale[:, j] = a[:, j].sum(axis=1)
            a[:, j] /= scale[:, j, None]
            if j:
                a[:, j] = np.where(mask[:, j, None] > 0, a[:, j], a[:, j - 1])
        b[:, -1] = move[:, 0]
        for j in range(size - 2, -1, -1):
            b[:, j] = np.where(mask[:, j + 1, None] > 0, (local[:, j + 1] * b[:, j + 1]) @ move.T / scale[:, j + 1, None], move[:, 0])
        z = (a[:, -1] * move[:, 0]).sum(axis=1)
        node = a * b / z[:, None, None] * mask[..., None]
        left = a[:, :-1] * (both / z[:, None])[..., None]
        right = local[:, 1:] * b[:, 1:] / scale[:, 1:, None]
        expected = move * (left.reshape(-1, k).T @ right.reshape(-1, k))
        expected[0] += node[:, 0].sum(axis=0)
        expected[:, 0] += node[np.arange(n), last].sum(axis=0)
        g = (onehot - node) / n
        by_word = np.zeros((len(words) + 1, 3, k))
        for shift, part in ((1, 0), (0, 1), (2, 2)):
            np.add.at(by_word[:, part], x[:, shift : shift + size], g)
        by_word[-1] = 0
        for value, grad, (m, v) in zip((w, t), (has.T @ by_word.reshape(-1, 3 * k) - l2 * w, (seen - expected) / n - l2 * t), moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    for kind in KINDS:  # a span can't go on where none of its kind began
        for i, name in enumerate(LABELS):
            if name not in (f"B-{kind}", f"I-{kind}"):
                t[i, label[f"I-{kind}"]] = -1e4
    return Field(index, w.reshape(-1, 3, k), t)


@functools.lru_cache(maxsize=4)
def trained_field(n: int = 600, seed: int = 7) -> Field:
    """The field trained on the module's labelled table."""
    return train(labelled_sentences(n, seed))


_SPACE = re.compile(r"\s")


def segments_of(text: str, whole: bool = False) -> list[list[tuple[int, str]]]:
    """Runs of (start, word) to decode: marked words, the triggers beside them, and a barred word or nothing at either end. whole: all words."""
    flat = text if text.isascii() and not _CONTROL.search(text) else _SPACE.sub(" ", text)
    n = len(flat)
    if whole:
        words = [(m.start(), m.group()) for m in _WORD.finditer(flat)]
        return [[(-1, ""), *words, (n + 1, "")]] if words else []
    out: list[list[tuple[int, str]]] = []
    at = 0  # where the last run ends
    while m := _MARK.search(flat, at):
        start = flat.rfind(" ", 0, m.start()) + 1
        run = []
        i = start
        while True:  # to the left
            while i > 0 and flat[i - 1] == " ":
                i -= 1
            if i <= 0:
                run.append((-1, ""))
                break
            s = flat.rfind(" ", 0, i) + 1
            run.append((s, flat[s:i]))
            if barred(flat[s:i]):
                break
            i = s
        run.reverse()
        i = start
        while True:  # the marked word and on to the right
            e = flat.find(" ", i)
            e = n if e < 0 else e
            run.append((i, flat[i:e]))
            if len(run) > 2 and barred(flat[i:e]):
                break
            at = i = e
            while i < n and flat[i] == " ":
                i += 1
            if i >= n:
                run.append((n + 1, ""))
                at = n
                break
        out.append(run)
    return out


_CONTROL = re.compile(r"[\t\n\r\x0b\x0c\x1c-\x1f]")
_WORD = re.compile(r"[^ ]+")


def field_spans(texts: list[str], field: Field, whole: bool = False) -> list[list[tuple[int, int, str]]]:
    """The field's spans in each text, without punctuation at either end."""
    runs, owner = [], []
    for i, text in enumerate(texts):
        for run in segments_of(text, whole):
            runs.append(run)
            owner.append(i)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, run, labels in zip(owner, runs, field.decode([[w for _, w in run] for run in runs]), strict=True):
        text = texts[i]
        j = 0
        while j < len(labels):
            name = LABELS[labels[j]]
            if name == "O":
                j += 1
                continue
            k = j + 1
            while k < len(labels) and LABELS[labels[k]] == f"I-{name[2:]}":
                k += 1
            start, end = run[j + 1][0], run[k][0] + len(run[k][1])
            while start < end and text[start] in _TRIM_LEFT.replace("(", ""):
                start += 1
            while end > start and text[end - 1] in _TRIM_RIGHT and not (text[end - 1] in "\"'" and text.count(text[end - 1], start, end) == 2):
                end -= 1
            if any(_MARK.search(run[m + 1][1]) for m in range(j, k)) and end > start:
                out[i].append((start, end, name[2:]))
            j = k
    return out


def find_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text its fixed spans, and the spans that the field adds, which never overlap those."""
    out = []
    for text, more in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        out.append((base, [s for s in more if not any(s[0] < e and b < s[1] for b, e, _ in base)] if base and more else more))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """Personal data of each row: doc_id, counts of the fixed patterns, base_sha256, spans, n_secret, n_added.

    A null text counts as empty and gives zero counts and an empty list; a null doc_id is kept; repeated rows give repeated
    rows; where spans of two kinds start together (ties) they are listed in the order of KINDS; other columns are left out and may have any name; an
    empty table gives an empty table. Long texts and words are searched whole.
    """
    prepare(docs.sparkSession)
    field = trained_field()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            rows = []
            texts = [t or "" for t in pdf["text"]]
            for base, more in find_spans(texts, field):
                count = [sum(k == kind for _, _, k in base) for kind in KINDS[:4]]
                both = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), sum(s[2] == "secret" for s in more), len(more)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_added"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in square brackets, overlapping spans by the first one's; n_chars follows. All columns and rows stay; a null text stays null."""
    prepare(docs.sparkSession)
    field = trained_field()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = find_spans([t or "" for t in texts], field)
            new = []
            for text, (base, more) in zip(texts, found, strict=True):
                if text is None or not base and not more:
                    new.append(text)
                    continue
                out, at = [], 0
                for s, e, kind in sorted(base + more):
                    if s >= at:
                        out += [text[at:s], f"[{kind.upper()}]"]
                    at = max(at, e)
                new.append("".join(out) + text[at:])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(b) if c is not None and a != b else c for a, b, c in zip(texts, new, old, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(replace, docs.schema)
