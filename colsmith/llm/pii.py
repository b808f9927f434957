"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

Patterns find e-mail and IP addresses, card and phone numbers in whole texts, in time linear in the text. The random field works on
tokens described by word shape and neighbours; it is trained, in a second, from a small labelled table in this module, and decoded by
Viterbi over numpy batches of token runs. It adds addresses and numbers in forms that the patterns don't take (spoken, spaced or
masked ones) and a fifth kind, secret: credentials such as the value of a token or password. Only tokens within REACH of a digit, an @
or a word such as "dot" can carry a label: that is part of the model, in training as in use, so the rest of a text needs no decoding,
and the runs that are cut out, by tokens, have the labels that a decoding of the whole text would give. Spans of the field are added
only where no pattern span is and what they hold is plausible.

Null text counts as empty and has no spans. Offsets are code points, the end exclusive. Repeated rows give repeated results; other
columns are ignored, whatever they are called; an empty table gives an empty table. A very long text is read token by token, and a
long run of tokens is decoded as one, however long, in time and memory linear in it.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsmith.llm.common import sub_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the field: those of the patterns, in the order in which spans are written, then its own.
FIELD_KINDS = (*KINDS, "secret")
REACH = 6
#: Tokens of a run on either side of a sign: REACH that may carry a label, and those that their features look at.
EDGE = REACH + 5
#: Tokens whose features are held at once, and padded tokens that are decoded at once.
PIECE, PADDED = 4096, 200_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits can only match from its first digit, so the others are passed over.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # nothing before an @ that failed can match: no local part holds an @
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


# ---- the random field ----

# Sixteen or more letters and digits mixed are one token.
_TOKEN = re.compile(r"(?=[A-Za-z]{1,15}[0-9]|[0-9]{1,15}[A-Za-z])[A-Za-z0-9]{16,}|[^\W\d_]+|[0-9]+|[^\s]")
_MIXED = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}")
_AT, _DOT = {"at", "arroba", "chez", "bei"}, {"dot", "punto", "punkt", "point"}
_SPOKEN_SIGNS = {"dot", "punto", "punkt", "point", "arroba"}
#: Texts without any of these have no sign.
_SIGN = re.compile(r"[0-9@]|dot|punto|punkt|point|arroba|[(\[]\s*at(?![a-z])", re.I)
_CUE = {"call", "phone", "tel", "telephone", "telefon", "mobile", "fax", "whatsapp", "ring", "text", "mail", "email", "write", "contact", "card", "visa", "mastercard", "credit", "ip", "host", "server", "address", "téléphone", "teléfono", "handy"}
_KEEP = {"token", "secret", "password", "passwd", "pwd", "passwort", "contraseña", "apikey", "key", "bearer", "credential", "auth", "authorization"}
LABELS = ["O"] + [f"{p}-{k}" for k in FIELD_KINDS for p in "BI"]

#: The labelled table: [kind text]. Digits are redrawn in training, ten times a line.
TABLE = """
reach me under [email anna dot meyer at mailbox dot org] any time
write to [email j.smith (at) example.com] for a copy
mail [email bob [at] corp [dot] net] or call
contact [email maria.lopez @ example . org] today
her address is [email tom_99 at example dot com] now
[email info AT firma PUNKT de] ist erreichbar
escribe a [email juan arroba correo punto es] hoy
send it to [email sales(at)shop.example.com] please
mail me [email kim at uni dot edu]
call [phone (743) 555-3824] after six
phone [phone 555-867-5309] and ask
tel [phone 030 1234567] oder
my number is [phone 212.555.0187] ok
mobile [phone 0171 2345678] bitte
ring [phone 020 7946 0958] before noon
fax [phone (021) 555 0142] only
call me on [phone 743-555-1055] tonight
telefon [phone 089/1234567] abends
text [phone 07700 900123] now
whatsapp [phone 0049 171 2345678] anytime
tel. [phone 1-800-555-0199] toll free
card [card 4111.1111.1111.1111] expires soon
visa [card 4111/1111/1111/1111] was charged
credit card no [card 5500_0000_0000_0004] on file
host [ip 192 . 168 . 12 . 4] is down
server [ip 10[.]20[.]30[.]40] answered
ip [ip 172(dot)16(dot)5(dot)9] blocked
it was 12 years ago in 1998 and 2004
chapter 3 section 14 page 205 says
the total is 4,512.75 for 33 items
order 48213377 shipped on 2021-03-14 at 10:45
version 2.10.4 of the library came out
see table 12 and figure 7.3 for more
we met at noon at the dot on the map
look at point 3 and point 4 of the list
he scored 102 points in 48 games
the code 8841 opens door 12 of 40
between 1914-1918 and 1939-1945 many left
isbn 978-3-16-148410-0 is out of print
about 100 000 people and 250 000 cars
token = "[secret 9f8a7c6b5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a]" and then
TOKEN = "[secret 9F8A7C6B5D4E3F2A1B0C9D8E7F6A5B4C3D2E1F0A]" AND THEN
the token = "[secret 4d44c79e8bf7c55759c4958dd60ed83d]" of it
secret: [secret a1b2c3d4e5f6a7b8c9d0] was found
api_key = '[secret sk4f9Kd83jLm20xQ7Zt1Vb]' in the file
key=[secret AKIA1234567890ABCD] secret 99
password: "[secret hG7kd93Jf02mPq81]" please change
Authorization: Bearer [secret eyJhbGciOiJIUzI1NiIs9] sent
auth token [secret 0a1b2c3d4e5f60718293] expired
commit 9f8a7c6b5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a fixed it
md5 d41d8cd98f00b204e9800998ecf8427e of the file
sha256: e3b0c44298fc1c149afbf4c8996fb924 matches
see build 4f9d83a20c7b1e5d6a8f for details
id = "550e8400e29b41d4a716446655440000" in the table
a token of thanks in 2019 and 12 keys
id 000123456789 was not found at all
at 3 pm or at 4 pm the 2 shops close
a1b2c3d4 and x9y8z7 are hashes
5 of 10 and 20 of 30 in 40
# @param x the 3 values @return none
follow @user12 and @name on it
the ratio 3:4 and 16:9 at 60 fps
copyright (c) 2015 - 2020 all rights reserved
error 404 at line 1024 col 17
"""


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in _TOKEN.finditer(text)]


@functools.lru_cache(1 << 16)
def shape(token: str) -> str:
    """Digits by number, letters by case, marks as they are."""
    if len(token) >= 16 and _MIXED.fullmatch(token):
        return "hash"
    if token.isascii() and token.isdigit():
        n = len(token)
        return f"d{n}" if n <= 4 else "d5-6" if n <= 6 else "d7-8" if n <= 8 else "d9-12" if n <= 12 else "d13+"
    if token[0].isalpha():
        low = token.lower()
        if low in _AT:
            return "w:at"
        if low in _DOT:
            return "w:dot"
        if low in _CUE:
            return "w:cue"
        if low in _KEEP:
            return "w:keep"
        return "x" if token.islower() else "X" if token.isupper() else "Xx"
    return token


def features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    s = ["<<", "<"] + [shape(t) for t, _, _ in tokens] + [">", ">>"]
    glue = [0] + [int(b[1] == a[2]) for a, b in zip(tokens, tokens[1:])] + [0]  # without white space between
    out = []
    for k in range(len(tokens)):
        a, b, c, d, e = s[k : k + 5]
        near = s[max(0, k - 2) : k + 2]  # the four tokens before, at most
        cue, keep = int("w:cue" in near), int("w:keep" in near)
        out.append([f"0{c}", f"-1{b}", f"+1{d}", f"-2{a}", f"+2{e}", f"-1{b}|{c}", f"+1{c}|{d}", f"-2{a}|{b}|{c}", f"+2{c}|{d}|{e}", f"1{b}|{c}|{d}", f"g{glue[k]}{glue[k + 1]}{c}", f"q{cue}{c}", f"k{keep}{c}", "b"])
    return out


def _is_sign(token: str, before: str) -> bool:
    """Digits, an @, a spoken dot or at; an "at" counts after an opening bracket."""
    return token.isascii() and (token[0].isdigit() or token == "@" or len(token) >= 16 and token[-1].isdigit() or bool(_MIXED.fullmatch(token)) or token.lower() in _SPOKEN_SIGNS or (token.lower() == "at" and before in ("(", "[")))


def may_be(tokens: list[tuple[str, int, int]]) -> np.ndarray:
    """Tokens within REACH of a sign."""
    words = [t for t, _, _ in tokens]
    sign = np.fromiter((_is_sign(t, b) for t, b in zip(words, ["", *words])), bool, len(words))
    near = sign.copy()
    for k in range(1, REACH + 1):
        near[k:] |= sign[:-k]
        near[:-k] |= sign[k:]
    return near


def _parse(line: str, rnd: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone|secret) ((?:[^\[\]]|\[[^\]]*\])*)\]", line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    text += line[at:]
    return "".join(rnd.choice("0123456789") if c.isdigit() else c for c in text), spans


class Field:
    """Weights of a linear-chain CRF."""

    def __init__(self, vocabulary: dict[str, int], state: np.ndarray, step: np.ndarray) -> None:
        self.vocabulary, self.state, self.step = vocabulary, state, step

    def emissions(self, feats: list[list[str]], near: np.ndarray) -> np.ndarray:
        look = self.vocabulary.get
        e = np.array([self.state[[i for f in fs if (i := look(f)) is not None]].sum(axis=0) for fs in feats]).reshape(len(feats), len(LABELS))
        e[~near, 1:] = -1e9
        return e

    def of(self, tokens: list[tuple[str, int, int]]) -> np.ndarray:
        """Emissions of a run, from the features of a piece at a time."""
        near = may_be(tokens)
        parts = []
        for a in range(0, len(tokens), PIECE):
            left = min(a, 5)
            feats = features(tokens[a - left : a + PIECE + 5])[left : left + PIECE]
            parts.append(self.emissions(feats, near[a : a + PIECE]))
        e = np.concatenate(parts)
        e[:1, [x.startswith("I-") for x in LABELS]] = -1e9  # a run begins with no label or a B-
        return e


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.zeros((len(seqs), n.max(), seqs[0].shape[1]))
    for k, s in enumerate(seqs):
        out[k, : len(s)] = s
    return out, n


def viterbi(seqs: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence of emissions, all of them a token at a time."""
    e, n = _padded(seqs)
    best, back = e[:, 0], np.zeros(e.shape, np.int8)
    for t in range(1, e.shape[1]):
        through = best[:, :, None] + step[None]
        back[:, t] = through.argmax(axis=1)
        on = (t < n)[:, None]
        best = np.where(on, through.max(axis=1) + e[:, t], best)
    out = [np.zeros(k, np.int64) for k in n]
    now = best.argmax(axis=1)
    for t in range(e.shape[1] - 1, -1, -1):
        for k in np.flatnonzero(t < n):
            out[k][t] = now[k]
        now = np.where(t < n, back[np.arange(len(n)), t, now], now)
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: str = TABLE, copies: int = 10, rounds: int = 60, ridge: float = 0.5) -> Field:
    """Maximum likelihood with a ridge, by Adam over the whole table; the same weights every time."""
    rnd = random.Random(7)
    sets = []
    for line in filter(None, map(str.strip, table.splitlines())):
        for _ in range(copies):
            text, spans = _parse(line, rnd)
            toks = tokens_of(text)
            tags = np.zeros(len(toks), np.int64)
            for kind, a, b in spans:
                inside = [k for k, (_, x, y) in enumerate(toks) if a <= x and y <= b]
                for k in inside:
                    tags[k] = LABELS.index(("B-" if k == inside[0] else "I-") + kind)
            sets.append((features(toks), tags, may_be(toks)))
    vocabulary = {f: k for k, f in enumerate(sorted({f for feats, _, _ in sets for fs in feats for f in fs}))}
    m = len(LABELS)
    n = np.array([len(t) for _, t, _ in sets])
    length = n.max()
    rows = np.concatenate([[k * length + t] * len(fs) for k, (feats, _, _) in enumerate(sets) for t, fs in enumerate(feats)])
    cols = np.array([vocabulary[f] for feats, _, _ in sets for fs in feats for f in fs])
    tags = np.zeros((len(sets), length), np.int64)
    barred = np.zeros((len(sets), length, m), bool)
    for k, (_, t, near) in enumerate(sets):
        tags[k, : len(t)] = t
        barred[k, : len(t), 1:] = ~near[:, None]
    on = np.arange(length)[None] < n[:, None]
    illegal = np.array([[b.startswith("I-") and a not in (f"B-{b[2:]}", b) for b in LABELS] for a in LABELS])
    gold = np.zeros((len(sets), length, m))
    gold[np.arange(len(sets))[:, None], np.arange(length)[None], tags] = on
    gold_step = np.zeros((m, m))
    pair = on[:, 1:]
    np.add.at(gold_step, (tags[:, :-1][pair], tags[:, 1:][pair]), 1)
    state, step = np.zeros((len(vocabulary), m)), np.zeros((m, m))
    moments = [np.zeros_like(state), np.zeros_like(state), np.zeros_like(step), np.zeros_like(step)]
    order = np.argsort(cols, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(cols[order]) > 0]))
    for r in range(1, rounds + 1):
        e = np.zeros((len(sets) * length, m))
        row_heads = np.flatnonzero(np.concatenate([[True], np.diff(rows) > 0]))
        e[rows[row_heads]] = np.add.reduceat(state[cols], row_heads, axis=0)
        e = np.where(barred, -1e4, e.reshape(len(sets), length, m))
        st = np.where(illegal, -1e4, step)
        e[:, 0, [b.startswith("I-") for b in LABELS]] = -1e4
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, length):
            fwd[:, t] = np.where(on[:, t, None], _logsum(fwd[:, t - 1][:, :, None] + st[None], 1) + e[:, t], fwd[:, t - 1])
        z = _logsum(fwd[:, -1], 1)
        for t in range(length - 2, -1, -1):
            bwd[:, t] = np.where(on[:, t + 1, None], _logsum(st[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
        p = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
        flow = np.zeros((m, m))
        for t in range(1, length):
            flow += (np.exp(fwd[:, t - 1][:, :, None] + st[None] + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]) * on[:, t, None, None]).sum(axis=0)
        diff = (gold - p).reshape(-1, m)
        g_state = np.zeros_like(state)
        g_state[cols[order][heads]] = np.add.reduceat(diff[rows[order]], heads, axis=0)
        for x, g, k in ((state, g_state - ridge * state, 0), (step, np.where(illegal, 0, gold_step - flow) - ridge * step, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
            x += 0.1 * (moments[k] / (1 - 0.9**r)) / (np.sqrt(moments[k + 1] / (1 - 0.99**r)) + 1e-8)
    return Field(vocabulary, state, np.where(illegal, -1e4, step))


@functools.lru_cache(1)
def field() -> Field:
    return train()


def _runs(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of tokens that hold every token within EDGE of a sign; no two share one."""
    if not _SIGN.search(text):
        return
    before: collections.deque = collections.deque(maxlen=EDGE)
    run: list[tuple[str, int, int]] = []
    quiet, last = 0, ""
    for m in _TOKEN.finditer(text):
        token = (m[0], m.start(), m.end())
        sign = _is_sign(token[0], last)
        last = token[0]
        if run:
            run.append(token)
            quiet = 0 if sign else quiet + 1
            if quiet == 2 * EDGE:  # the next run, EDGE tokens before its sign, can't reach into this one
                yield run[:-EDGE]
                before.extend(run[-EDGE:])
                run = []
        elif sign:
            run = [*before, token]
            quiet = 0
        else:
            before.append(token)
    if run:
        yield run


def _decoded(runs: list[list[tuple[str, int, int]]], model: Field) -> Iterator[tuple[int, np.ndarray]]:
    """(number, labels) of each run; runs of like length together."""
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(runs[order[upto]]) <= PADDED:
            upto += 1
        batch = order[at:upto]
        yield from zip(batch, viterbi([model.of(runs[i]) for i in batch], model.step))
        at = upto


#: A spoken or spaced address: the sign, a name, a dot, the name of a domain.
_SPOKEN = re.compile(r"\w\W{0,2}(?:@|\b(?:at|arroba|chez|bei)\b)\W{0,2}[\w-]+(?: ?\. ?|\W{0,2}\b(?:dot|punto|punkt|point)\b\W{0,2})[\w-]{2,}", re.I)


#: By label: whether a span begins there. The label after a B- is the I- of its kind.
_BEGINS = np.array([x.startswith("B-") for x in LABELS])


def _plausible(kind: str, piece: str) -> bool:
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "secret":
        return len(piece) >= 12 and not re.search(r"\s", piece) and bool(re.search("[0-9]", piece)) and bool(re.search("[A-Za-z]", piece))
    return len(tokens_of(piece)) <= 16 and bool(_SPOKEN.search(piece))


def found_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds, text by text."""
    runs, where = [], []
    for k, text in enumerate(texts):
        for run in _runs(text):
            runs.append(run)
            where.append(k)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, tags in _decoded(runs, model):
        k, toks = where[i], runs[i]
        for t in np.flatnonzero(_BEGINS[tags]).tolist():
            kind, end = LABELS[tags[t]][2:], t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            a, b = toks[t][1], toks[end - 1][2]
            if _plausible(kind, texts[k][a:b]) and not any(a < y and x < b for _, x, y in base[k]):
                out[k].append((kind, a, b))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (FIELD_KINDS.index(s[0]), s[1], s[2])))


_COLUMNS = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret"]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of pattern spans by kind, base_sha256 of them, and all spans, those of the field included: n_added in
    number, n_secret of them secrets, which come after the other kinds."""

    model = field()  # trained here once, sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in sub_batches(np.array(batch.column(2), np.int64)):
                part = batch.slice(a, b - a)
                texts = part.column(1).to_pylist()
                base = [base_spans(t) for t in texts]
                more = found_spans(texts, base, model)
                counts = [pa.array([sum(s[0] == kind for s in x) for x in base], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(_written(x).encode()).hexdigest() for x in base])
                spans = pa.array([_written(x + y) for x, y in zip(base, more)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, spans, pa.array([len(y) for y in more], pa.int64()), pa.array([sum(z[0] == "secret" for z in y) for y in more], pa.int64())], _COLUMNS)

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.length(text_or_empty()).alias("chars"))
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long")


def redact(text: str, mask: str = "[{kind}]") -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced together."""
    base = base_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + found_spans([text], [base], field())[0], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mask.format(kind=kind.upper())]
        at = max(at, b)
    return "".join(out) + text[at:]
