"""PII: base patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table, made by the rules below (gradient of the exact log-likelihood,
forward-backward over all lines side by side) and decoded by Viterbi over all lines of a slice at once, in numpy. Its
labels are the kinds of personal data; features are the shape of a word (runs of letters, runs of digits with their
lengths, and marks), the shapes of its neighbours, and flags of all three. A run of words with one label is a span of
the method if the posterior of each of its words is at least SURE (a card's digits have to pass Luhn as well) and it
overlaps no base span; base spans stay as they are.

Spans are `kind:start:end` in code points, end exclusive, by kind (email, ip, card, phone) and start.

Cases: a null text is empty and has no spans. Repeated documents are reported each. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from octolith.llm.common import raw, text_slices, texts_only

KINDS = ["email", "ip", "card", "phone"]
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Where one digit of a run can't begin a match, none of the run can: the look-behind saves trying each.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, leftmost and without overlaps."""
    email, at, low = [], text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            before = text[low:at]
            start = low + len(before.rstrip(_LOCAL))
            if start < at:
                email.append((start, m.end()))
                low = m.end()
            else:
                low = at + 1
        else:
            low = at + 1
        at = text.find("@", max(at + 1, low))
    ip = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    card = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d)]
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [email, ip, card, phone]


#: What the labelled table is made of: # is a digit, & a word, ~ a name, ^ a hexadecimal group; the rest stands for itself.
FORMS = {
    "email": ["~ at & dot ~", "~.~ at & dot ~", "~ (at) & (dot) ~", "~ [at] & [dot] ~", "~.~ [at] &-& [dot] ~", "~(at)&.~", "~[at]&[dot]~", "~.~(at)&.~", "~ at &.~", "~## at & dot ~", "~ punkt ~ at & punkt ~"],
    "ip": ["^:^:^:^:^:^:^:^", "####:^^##::#", "####:db#::#", "fe80::^:^:^:^", "####:^^#:#:#:#:#:#:#"],
    "card": ["####-####-####-####", "#### #### #### ####", "####.####.####.####", "#### ###### #####", "#### #### #### #### ###"],
    "phone": ["(###) ###-####", "(###) ### ####", "(###)###-####", "###-###-####", "###.###.####", "0### #######", "0##/#######", "(0##) ###-####", "(0##) ######", "0# ## ## ## ##", "0#.##.##.##.##", "0## #### ####", "0#### ######", "0###-#######", "00## ## #######"],
}
#: Lines around it, in four languages.
LINES = [
    "write to {} for details", "call {} after six", "tel: {} evenings", "my number is {} thanks", "{} is what he gave us", "please use {} before noon", "we know {} from the file", "und {} war der Eintrag",
    "schreib an {} bitte", "sous {} demain", "contacte {} hoy", "{}", "& & {} & &", "& {} &", "&: {}, & &", "& & {}.", "| & | {} | & |", "id ## {} &",
]
#: Lines without any.
OTHERS = [
    "& & & & & &", "we met at the & of an old & and left at dawn", "he looked at a dot com boom in ####", "the total was #,###,###.## in #### and ## in ####", "see pages ##-## and ## (part #) for the &", "version #.#.# was released on ####-##-## at ##:##",
    "born ##/##/#### in a & of ## ### people", "chapter #: the & (####-####) and after", "isbn ###-#-##-######-# is on the &", "order ###### shipped on ##.##.#### for ##.##", "| & | & | ## | ##.# | ## |", "at the end of the &, at last, at home",
    "dot by dot the map was drawn at scale #:#####", "los de la que en un por con #### y ####", "der die das und in ## Jahren bei ## Grad", "le la les de un ## juillet #### dans", "key sk-ab##cd##ef## must stay &", "id 0x#f#a ##ab##cd ######## and so on", "http://www.&.com/&/&?c=# is a &",
    "# # # # # ## ## ##", "## ### #### ### ##", "&, &. & & (& &) &; &", "### ### ###", "#### #### &", "run at ##:##:## and ##:##:##.###", "& at & & &", "& dot & & at &", "###-### & ##-###", "(###) & (##) &", "### & #### & #### &", "$###.## & ##% &", "####.##.##", "## ## ##", "#,### &",
    "AB##### & AB##-##", "& ################ &", "0.### & 0.## &", "00 & 0### &", "a:b:c & 1:2:3 &", "&::& & ::", "std::& & x::y", "meet & at ##", "& [##] & (&)", "&(&) & f(x)", "&[&]", "{\"&\": ##, \"&\": #}", "####/##/## ##:##", "+## &", "#-#-#", "##-##-##",
]
NAMES = ["anna", "petra", "luc", "maria", "j", "weber", "k", "smith", "oduya", "li", "nguyen", "com", "de", "org", "net", "es", "fr", "info", "uk"]
WORDS = ["haus", "mail", "firma", "example", "poste", "the", "over", "la", "un", "des", "with", "note", "casa", "river", "Zeit", "Note", "item", "value", "été", "für", "of", "uni", "web"]


def labelled_table(seed: int, rows: int = 1200) -> list[str]:
    """Lines with personal data in <kind>..</kind>, and as many without any, made from the forms by a generator."""
    g = random.Random(seed)

    def filled(form: str) -> str:
        hexed = lambda: "".join(g.choice("0123456789abcdef") for _ in range(g.randint(1, 4)))
        own = {"#": lambda: g.choice("0123456789"), "&": lambda: g.choice(WORDS), "~": lambda: g.choice(NAMES), "^": hexed}
        return "".join(own[c]() if c in own else c for c in form)

    def data(kind: str) -> str:
        text = filled(g.choice(FORMS[kind]))
        while kind == "card" and not _luhn(re.sub("[^0-9]", "", text)):
            text = filled(g.choice(FORMS[kind]))
        return f"<{kind}>{text.upper() if kind == 'email' and g.random() < 0.1 else text}</{kind}>"

    out = []
    for i in range(rows):
        plain = filled(g.choice(OTHERS if i % 2 else LINES).replace("{}", "\0")).split("\0")
        out.append(data(KINDS[i // 2 % len(KINDS)]).join(plain) if len(plain) == 2 else plain[0])
    return out


#: Of a span of the method, the posterior of each word is this at least.
SURE = 0.7

_B = np.arange(256)
#: Shape of a byte: letters x, digits d, other bytes themselves.
_SHAPE = np.where(((_B | 32) >= 97) & ((_B | 32) <= 122) | (_B >= 128), 120, np.where((_B >= 48) & (_B <= 57), 100, _B)).astype(np.uint8)
_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
_AT, _DOT = re.compile(rb"[\[(]?at[\])]?", re.I), re.compile(rb"[\[(]?(?:dot|punkt|punto|point)[\])]?", re.I)
_TAIL = np.isin(_B, [*b".,;:!?"])
_HEX = np.isin(_B | 32, [*range(97, 103)]) | (_B >= 48) & (_B <= 57)
#: Flags of a word, in two tables of combinations.
_FLAGS, _LOW = 18, 9
_BUCKETS = 1 << 12


class Tokens:
    """White-space words of a slice, each with flags and a bucket for its shape; lines are the sequences."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        inside = ~_SPACE[data]
        before = np.r_[False, inside[:-1]] if len(data) else inside
        after = np.r_[inside[1:], False] if len(data) else inside
        edge = at[:-1][at[:-1] < len(data)]
        before[edge] = False
        after[(at[1:] - 1)[(at[1:] > 0) & (at[1:] <= len(data))]] = False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        n = len(self.start)
        self.doc = np.searchsorted(at, self.start, "right") - 1
        shape = _SHAPE[data]
        turn = np.r_[True, shape[1:] != shape[:-1]] if len(data) else inside
        turn[self.start] = True
        turn |= (shape != 120) & (shape != 100)  # marks each by themselves
        kept = np.flatnonzero(turn & inside)
        first = np.searchsorted(kept, self.start)
        code = np.zeros(n, np.uint64)
        if n:  # a hash of the word's shape, its runs in order
            place = (np.arange(len(kept)) - np.repeat(first, np.diff(np.r_[first, len(kept)]))).astype(np.uint64)
            long = np.diff(np.r_[kept, len(data)])
            long = np.minimum(long, self.end[np.searchsorted(self.start, kept, "right") - 1] - kept)
            # Marks at a word's end don't count.
            last = self.end - 1
            strip = _TAIL[data[last]] & (self.end - self.start > 1)
            drop = np.zeros(len(data), bool)
            drop[last[strip]] = True
            symbol = shape[kept].astype(np.uint64) + np.uint64(1) + np.where(shape[kept] == 100, np.minimum(long, 7), 0).astype(np.uint64) * np.uint64(256)
            symbol[drop[kept]] = 0
            code = np.add.reduceat(symbol * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), first)
        self.shape = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64) % _BUCKETS
        size = self.end - self.start
        owner = lambda places: np.searchsorted(self.start, places, "right") - 1
        digits = np.bincount(owner(np.flatnonzero(shape == 100)), minlength=n)
        marks = np.flatnonzero(inside & (shape != 100) & (shape != 120))
        mark, of = data[marks], owner(marks)
        letters = size - digits - np.bincount(of, minlength=n)
        count = lambda c: np.bincount(of[mark == ord(c)], minlength=n)
        is_at, is_dot = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            head = data[self.start] | 32
            for i in np.flatnonzero((letters >= 2) & (letters <= 5) & (size <= 7) & (digits == 0) & ((letters < size) | (size == 2) & (head == 97) | (size > 2) & np.isin(head, (100, 112)))):
                w = data[self.start[i] : self.end[i]].tobytes()
                is_at[i], is_dot[i] = bool(_AT.fullmatch(w)), bool(_DOT.fullmatch(w))
        colons = count(":")
        hexed = np.bincount(owner(np.flatnonzero(inside & (_HEX[data] | (data == 58)))), minlength=n) == size
        # (at) inside a word, after something
        inner = np.zeros(n, bool)
        opening = np.flatnonzero(np.isin(data[:-3], (40, 91)) & (data[1:-2] | 32 == 97) & (data[2:-1] | 32 == 116) & np.isin(data[3:], (41, 93))) if len(data) > 3 else at[:0]
        opening = opening[inside[opening]]
        inner[owner(opening)] = self.start[owner(opening)] < opening
        begins = data[self.start] if n else data
        flags = [np.ones(n, bool), letters == size, (digits == size) & (size <= 2), (digits == size) & (size == 3), (digits == size) & (size == 4), (digits == size) & (size > 4), (digits >= 7) & (digits <= 12), digits >= 13, (count("(") > 0) & (count(")") > 0)]
        flags += [is_at, is_dot, colons >= 4, hexed & (colons >= 2) & (digits < size - colons), hexed & (colons >= 2), inner, (begins == 48) & (digits >= 2), self._beside(is_dot, 2, at) & is_at, self._beside(is_at, -2, at) & is_dot]
        self.flags = sum((f.astype(np.int64) << i for i, f in enumerate(flags)), np.zeros(n, np.int64))
        line = np.cumsum(data == 10)[self.start] if n else np.zeros(0, np.int64)
        self.first = np.r_[True, (np.diff(line) != 0) | (np.diff(self.doc) != 0)] if n else np.zeros(0, bool)

    def _beside(self, flag: np.ndarray, step: int, at: np.ndarray) -> np.ndarray:
        """The flag of the word that many words on, in the same text."""
        to = np.arange(len(flag)) + step
        ok = (to >= 0) & (to < len(flag))
        to = np.where(ok, to, 0)
        return ok & flag[to] & (self.doc[to] == self.doc) if len(flag) else flag

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags (as bits) of each word, of the one before and of the one after it in its line."""
        return self._around(self.flags, 0)

    def shapes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the shapes of the same; a line has an edge of a bucket of its own."""
        return self._around(self.shape, _BUCKETS)

    def _around(self, x: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before, after = np.full_like(x, edge), np.full_like(x, edge)
        before[1:], after[:-1] = x[:-1], x[1:]
        before[self.first] = edge
        after[:-1][self.first[1:]] = edge
        return x, before, after


_COMBINATIONS = (np.arange(1 << _LOW)[:, None] >> np.arange(_LOW) & 1).astype(np.float64)


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([_COMBINATIONS[flags & (1 << _LOW) - 1], _COMBINATIONS[flags >> _LOW]], 1)


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis, keepdims=True)
    return m.squeeze(axis) + np.log(np.exp(v - m).sum(axis))


class Field:
    """Weights: of the shapes' buckets, of the flags, and from label to label (label 0 is none)."""

    def __init__(self):
        k = len(KINDS) + 1
        self.shape, self.flag, self.step = np.zeros((3, _BUCKETS + 1, k)), np.zeros((3 * _FLAGS, k)), np.zeros((k, k))

    def scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.start), len(KINDS) + 1))
        for i, bits in enumerate(t.around()):
            w = self.flag[i * _FLAGS : (i + 1) * _FLAGS]
            out += (_COMBINATIONS @ w[:_LOW])[bits & (1 << _LOW) - 1]
            out += (_COMBINATIONS @ w[_LOW:])[bits >> _LOW]
        for i, bucket in enumerate(t.shapes()):
            out += self.shape[i][bucket]
        return out

    @staticmethod
    def lines(t: Tokens, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First words of the lines (that have a word in `some`), longest line first, and their lengths."""
        at = np.flatnonzero(t.first)
        n = np.diff(np.r_[at, len(t.start)])
        if some is not None:
            keep = np.logical_or.reduceat(some, at)
            at, n = at[keep], n[keep]
        order = np.argsort(-n, kind="stable")
        return at[order], n[order]

    def decode(self, t: Tokens) -> np.ndarray:
        """The best label of every word: Viterbi over all lines side by side.

        A word's label other than none can gain at most its score's lead and twice the best step's; a line
        in which that is negative for all words has no labels and is left out.
        """
        out = np.zeros(len(t.start), np.int64)
        if not len(out):
            return out
        e = self.scores(t)
        lead = e[:, 1:].max(1) - e[:, 0] + 2 * max(0.0, self.step.max() - self.step[0, 0])
        at, n = self.lines(t, lead >= 0)
        if not len(at):
            return out
        best, back = e[at], []
        ends = []
        for i in range(1, int(n[0])):
            live = int(np.searchsorted(-n, -i, "left"))  # lines with more than i words
            ends.append(best[live:])
            best = best[:live]
            way = best[:, :, None] + self.step
            back.append(way.argmax(1))
            best = way.max(1) + e[at[:live] + i]
        ends.append(best)
        label = np.zeros(0, np.int64)
        for i in range(int(n[0]) - 1, -1, -1):
            label = np.r_[label, ends[i].argmax(1)]
            out[at[: len(label)] + i] = label
            if i:
                label = np.take_along_axis(back[i - 1], label[:, None], 1)[:, 0]
        return out

    def marginals(self, e: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines at `at` (longest first): posteriors of their words' labels, alpha, beta and log Z at each word."""
        alpha, beta, z = np.zeros_like(e), np.zeros_like(e), np.zeros(len(e))
        alpha[at] = e[at]
        live = np.searchsorted(-n, -np.arange(int(n[0]) + 1), "left").tolist()  # lines with more than i words
        for i in range(1, int(n[0])):
            a = at[: live[i]] + i
            alpha[a] = _lse(alpha[a - 1][:, :, None] + self.step, 1) + e[a]
        for i in range(int(n[0]) - 2, -1, -1):
            a = at[: live[i + 1]] + i
            beta[a] = _lse(self.step + (e[a + 1] + beta[a + 1])[:, None, :], 2)
        total = _lse(alpha[at + n - 1], 1)
        for i in range(int(n[0])):
            z[at[: live[i]] + i] = total[: live[i]]
        return np.exp(alpha + beta - z[:, None]), alpha, beta, z

    def gradient(self, t: Tokens, gold: np.ndarray, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The log-likelihood of the gold labels, and its slope in each weight. x: the flags of each word, around() side by side."""
        at, n = self.lines(t)
        e, inner = self.scores(t), np.flatnonzero(~t.first)
        p, alpha, beta, z = self.marginals(e, at, n)
        pair = np.exp(alpha[inner - 1][:, :, None] + self.step + (e[inner] + beta[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
        seen = np.zeros_like(self.step)
        np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
        value = e[np.arange(len(gold)), gold].sum() + (seen * self.step).sum() - z[at].sum()
        rest = np.eye(len(self.step))[gold] - p
        shape = np.zeros_like(self.shape)
        for i, bucket in enumerate(t.shapes()):
            np.add.at(shape[i], bucket, rest)
        return float(value), [shape, x.T @ rest, seen - pair]

    def fit(self, t: Tokens, gold: np.ndarray, rounds: int = 100, rate: float = 0.5, decay: float = 0.005) -> None:
        """Gradient ascent (scaled by Adagrad) on the log-likelihood of the gold labels."""
        weights, x = (self.shape, self.flag, self.step), np.concatenate([_bits(b) for b in t.around()], 1)
        sums = [np.full(w.shape, 1e-8) for w in weights]
        for _ in range(rounds):
            for w, d, s in zip(weights, self.gradient(t, gold, x)[1], sums):
                d -= decay * w
                s += d * d
                w += rate * d / np.sqrt(s)


def labelled(table: list[str]) -> tuple[Tokens, np.ndarray]:
    """The words of a labelled table and their labels."""
    texts, labels = [], []
    for row in table:
        plain, spans, at = "", [], 0
        for part in re.split(r"(</?[a-z]+>)", row):
            if m := re.fullmatch(r"<(/?)([a-z]+)>", part):
                if m[1]:
                    spans.append((at, len(plain), 1 + KINDS.index(m[2])))
                at = len(plain)
            else:
                plain += part
        texts.append(plain)
        labels += [next((k for a, z, k in spans if m.start() < z and m.end() > a), 0) for m in re.finditer(r"\S+", plain)]
    return Tokens(*raw(pa.array(texts))), np.array(labels)


@lru_cache(maxsize=1)
def train(seed: int = 1) -> Field:
    field = Field()
    field.fit(*labelled(labelled_table(seed)))
    return field


_TRIM = b".,;:!?\"'"


def spans_of(field: Field, texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """Of each text, the spans (kind, start, end in bytes) that the field is sure of."""
    data, at = raw(texts)
    t = Tokens(data, at)
    label = field.decode(t)
    if not label.any():
        return {}
    lines, n = field.lines(t, label > 0)
    sure = field.marginals(field.scores(t), lines, n)[0][np.arange(len(label)), label]
    found: dict[int, list[tuple[int, int, int]]] = {}
    starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]] | t.first)
    for a, z in zip(starts, np.r_[starts[1:], len(label)]):
        if label[a] and sure[a:z].min() >= SURE:
            s, e = int(t.start[a]), int(t.end[z - 1])
            part = data[s:e].tobytes()
            s += len(part) - len(part.lstrip(_TRIM))
            part = part.strip(_TRIM)
            if KINDS[label[a] - 1] != "card" or _luhn(re.sub(rb"[^0-9]", b"", part).decode()):
                found.setdefault(int(t.doc[a]), []).append((int(label[a]) - 1, s - int(at[t.doc[a]]), s - int(at[t.doc[a]]) + len(part)))
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = docs.sparkSession.sparkContext.broadcast(train())

    def method_spans(texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
        return spans_of(field.value, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, texts in text_slices(b):
                more, out = method_spans(texts), []
                for k, text in enumerate(texts.to_pylist()):
                    base = base_spans(text)
                    every = [(i, s, e) for i, spans in enumerate(base) for s, e in spans]
                    digest = hashlib.sha256(",".join(f"{KINDS[i]}:{s}:{e}" for i, s, e in every).encode()).hexdigest()
                    if k in more:
                        data = text.encode()
                        own = [(i, len(data[:s].decode()), len(data[:e].decode())) for i, s, e in more[k]]
                        every += [x for x in own if not any(s < x[2] and x[1] < e for _, s, e in every)]
                    out.append((*map(len, base), digest, ",".join(f"{KINDS[i]}:{s}:{e}" for i, s, e in sorted(every))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, end - row), *(pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 4 + [pa.string()] * 2))], names=[x.split()[0] for x in OUT.split(", ")])

    return texts_only(docs).mapInArrow(run, OUT)
