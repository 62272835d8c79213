"""Secret scans: fixed base patterns and a linear-chain conditional random field.

The field tags every token (runs without white space, quotes, brackets and `,;:=|`) as begin, inside or outside of a secret.
Features: the token's own shape (length, kinds of characters, how usual its pairs of letters are, known beginnings), the two
words before it and the one after it, what separates it from the word before (line break, `=`, `:`, quotes), whether these
words are cues, and the file: how much of it is settings (`=`, `:`) and whether it has a cue at all; and kind of token
together with cue, separator and file.

Decoding is exact Viterbi. Where the emissions of a token speak for outside by more than any transition could make up for
(the bound is in `sure`), its best label is outside; such tokens, nearly all of prose, cut the chain, and only the stretches
between them are walked. Emissions are sums of table rows, looked up for the tokens of a text at once.

The model is trained here, on texts that are made from a fixed seed (`examples`), once per process that plans a query.

Nulls: a null text is empty and has no spans. Repeated rows are scanned each. An empty table gives an empty result. Other
columns are ignored. Memory: one Arrow batch of texts, and MAX_KNOWN tokens with their table rows. No shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvar.llm.common import sliced

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

O, B, I = range(3)
TOKEN = re.compile(r"""[^\s"'`,;:=<>()\[\]{}|]+""")
LETTERS = re.compile(r"[A-Za-z]+")
#: What the letters of a word have in them that announces a secret.
CUES = re.compile("|".join(("passw", "pwd", "passphrase", "secret", "token", "apikey", "accesskey", "privatekey", "signingkey", "credential", "authorization", "bearer", "recoverycode", "backupcode", "authkey", "encryptionkey")))
#: Words that the features know by name.
KNOWN = frozenset("is the with to set use for was your my our new and or a an of login user username name id host port url version date file path type value hash commit sha checksum md5 etag uuid session cookie export env string phone tel call mail https http key private auth basic code codes recovery backup access api".split())
#: How the keys of well-known services begin.
BEGINS = ("AKIA", "ghp_", "gho_", "sk_live_", "sk-", "pk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-", "SG.", "npm_")
#: The pairs of letters that prose has most.
PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo ge ie ee em ad ol po na ul ni ts mo pa im mi ai".split())
TOKEN_KINDS = ("lower", "title", "upper", "mixed", "number", "digits", "short", "medium", "long", "hex", "marked", "address", "dashed", "other")
GAPS, FILES, NEAR = 16, 8, 3
MAX_KNOWN = 300_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower() if len(text) else ""
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def name_of(token: str) -> str:
    """A word as the features of its neighbours know it: its name, `cue`, `#` without letters, else `?`."""
    low = token.lower() if token.isalpha() else "".join(LETTERS.findall(token)).lower()
    if len(low) <= 24 and CUES.search(low):
        return "cue"
    return low if low in KNOWN else "?" if low else "#"


def kind_of(token: str) -> int:
    core = token.rstrip(".!?")
    n = len(core)
    if "@" in core or "//" in core:
        name = "address"
    elif core.isalpha():
        name = "lower" if core.islower() else "title" if core[1:].islower() or n == 1 else "upper" if core.isupper() else "mixed"
    elif core.isdigit():
        name = "digits"
    elif re.fullmatch(r"[+(]?[0-9][0-9().+/%-]*", core):
        name = "number"
    elif n >= 16 and re.fullmatch(r"[0-9a-fA-F]+", core):
        name = "hex"
    elif re.fullmatch(r"[A-Za-z0-9]+", core):
        name = "short" if n < 8 else "medium" if n < 16 else "long"
    elif re.fullmatch(r"[A-Za-z0-9]+([-._/][A-Za-z0-9]+)+", core):
        name = "dashed"
    else:
        name = "marked" if re.search(r"[!#$%&*+?^~]", core) and re.search(r"[A-Za-z0-9]", core) else "long" if n >= 24 and re.search("[A-Za-z0-9]{8}", core) else "other"
    return TOKEN_KINDS.index(name)


def shape(token: str) -> tuple[str, ...]:
    """Features of a token alone."""
    core = token.rstrip(".!?")
    size = len(core)
    n = max(size, 1)
    kind = TOKEN_KINDS[kind_of(token)]
    low = core.lower()
    digits = upper = other = turns = cases = 0
    if kind != "lower":
        digits = sum(map(str.isdigit, core))
        upper = sum(map(str.isupper, core))
        other = size - digits - sum(map(str.isalpha, core))
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:])) if digits else 0
        cases = sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(core[1:], core[2:])) if upper else 0
    some = [x for x in map(operator.add, low, low[1:]) if x.isalpha()]
    usual = sum(map(PAIRS.__contains__, some)) * 4 // len(some) if some else 9
    out = ["bias", f"kind-{kind}", f"kind-{kind}-len{min(n // 4, 12)}", f"digit{digits * 4 // n}", f"upper{upper * 4 // n}", f"other{min(other, 4)}", f"turns{min(turns, 6)}", f"cases{min(cases, 5)}", f"mix{(digits > 0) + 2 * (upper > 0) + 4 * (size > digits + upper + other)}", f"usual{usual}", f"usual{usual}-len{min(n // 4, 8)}"]
    if not core.isascii():
        out.append("beyond-ascii")
    out += [f"begins-{b}" for b in BEGINS if token.startswith(b)]
    if size >= 12 and len(set(core)) >= 12:
        out.append("varied")
    return tuple(out)


def gap_of(gap: str) -> int:
    """What separates two tokens."""
    return ("\n" in gap) + 2 * (1 if "=" in gap else 2 if ":" in gap else 3 if gap.strip("\"'` \n\r\t") else 0) + 8 * ('"' in gap or "'" in gap or "`" in gap)


SETTING = frozenset(g for g in range(16) if g & 6 in (2, 4))


def file_of(gaps: list[int], has_cue: bool) -> int:
    """How much of a text is settings, and whether it has a cue."""
    share = sum(map(SETTING.__contains__, gaps)) / max(len(gaps), 1)
    return (0 if share < 0.01 else 1 if share < 0.05 else 2 if share < 0.2 else 3) + 4 * has_cue


class Words(dict):
    """Token to its class in the tables of a field. Tokens of one class have the same features: own emissions, those that
    they give to their neighbours, kind and cue."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.classes, self.rows = field, {}, []
        self.tables: tuple[np.ndarray, ...] | None = None

    def __missing__(self, token: str) -> int:
        name = name_of(token) if len(token) <= 64 else "?"
        key = (shape(token), name)
        k = self.classes.get(key)
        if k is None:
            k = self.classes[key] = len(self.rows)
            total = self.field.sum
            self.rows.append((total(key[0]), total([f"p1={name}"]), total([f"p2={name}"]), total([f"n1={name}"]), kind_of(token), name == "cue"))
            self.tables = None
        self[token] = k
        return k

    def table(self) -> tuple[np.ndarray, ...]:
        """By class: own emissions, those of the next token, of the one after it, of the token before, kind, cue."""
        if self.tables is None:
            self.tables = tuple(np.array(x) for x in zip(*self.rows))
        return self.tables

    def trim(self) -> None:
        if len(self) > MAX_KNOWN:
            self.clear()


class Field:
    """Linear-chain conditional random field over the labels O, B, I; I never starts a text or follows O."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.words: Words | None = None

    def __getstate__(self):
        return self.index, self.emit, self.move

    def __setstate__(self, state):
        self.index, self.emit, self.move = state
        self.words = None

    def sum(self, names: list[str]) -> np.ndarray:
        return self.emit[[self.index[n] for n in names if n in self.index]].sum(0)

    def ready(self) -> Words:
        if self.words is None:
            self.words = Words(self)
            self.given = np.array([[[self.sum([f"g={g}", joint_name(k, c, g)]) for g in range(GAPS)] for c in range(NEAR)] for k in range(len(TOKEN_KINDS))])
            self.in_file = np.array([[self.sum([file_name(k, f)]) for f in range(FILES)] for k in range(len(TOKEN_KINDS))])
            m = self.move
            into = [max(m[k, x] - m[k, O] for k in range(3) if m[k, x] > -1e6) for x in (B, I)]
            out = [max(m[x, k] - m[O, k] for k in (O, B)) for x in (B, I)]
            #: of I after the token, which then must become B: without the emissions
            more = [m[x, I] - m[O, B] + max(m[I, k] - m[B, k] for k in range(3)) for x in (B, I)]
            self.bounds = np.array(into), np.array(out), np.array(more)
        return self.words

    def emissions(self, text: str) -> tuple[np.ndarray, list[str], list[str]]:
        """(scores of O, B, I by token, tokens, what lies before, between and after them)."""
        words = self.ready()
        tokens, gaps = TOKEN.findall(text), TOKEN.split(text)
        n = len(tokens)
        if not n:
            return np.zeros((0, 3)), tokens, gaps
        ids = np.fromiter(map(words.__getitem__, tokens), np.int64, n)
        own, before, before2, after, kinds, cues = words.table()
        between = list(map(GAP_CODES.__getitem__, gaps[:n]))
        g, cue = np.array(between), cues[ids]
        near = np.zeros(n, np.int64)
        near[2:] = cue[:-2]
        near[1:][cue[:-1]] = 2
        kind = kinds[ids]
        s = own[ids] + self.given[kind, near, g]
        s += self.in_file[kind, file_of(between, bool(cue.any()))]
        s[1:] += before[ids[:-1]]
        s[2:] += before2[ids[:-2]]
        s[:-1] += after[ids[1:]]
        s[0, I] = -1e9
        return s, tokens, gaps

    def sure(self, s: np.ndarray) -> np.ndarray:
        """Tokens whose best label is outside, whatever the others are. Say one is x in a labelling: make it O, and an I that
        follows it B. That changes three transitions and two emissions; if what they can lose is less than what O gains, no
        best labelling has x there."""
        into, out, more = self.bounds
        after = np.append(np.maximum(s[1:, I] - s[1:, B], -1e9), -1e9)
        fine = np.ones(len(s), bool)
        for j, x in enumerate((B, I)):
            gain, loss = np.full(len(s), into[j]), np.maximum(out[j], more[j] + after)
            if len(s):  # no transition leads to the first token or from the last
                gain[0], loss[-1] = 0, 0
            fine &= s[:, O] - s[:, x] > gain + loss
        return fine

    def viterbi(self, s: np.ndarray, first: bool = True, last: bool = True) -> list[int]:
        """The best labels of tokens with these emissions; outside tokens lie before them, if not `first`, and after them, if not `last`."""
        best, back = s[0] if first else s[0] + self.move[O], []
        for row in s[1:]:
            way = best[:, None] + self.move
            back.append(way.argmax(0))
            best = way.max(0) + row
        path = [int((best if last else best + self.move[:, O]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def labels(self, s: np.ndarray) -> np.ndarray:
        """The best labels of a whole text."""
        out = np.zeros(len(s), np.int64)
        open_ = np.flatnonzero(~self.sure(s))
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            a, b = run[0], run[-1] + 1
            out[a:b] = self.viterbi(s[a:b], a == 0, b == len(s))
        return out

    def fit(self, data: list[tuple[list[list[str]], list[int]]], rounds: int = 100, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Adam on the log-likelihood of all texts, by forward and backward sums."""
        size = np.array([len(gold) for _, gold in data])
        n, t = len(data), int(size.max())
        at = np.concatenate([r * t + np.arange(k) for r, k in enumerate(size)])
        names = [[self.index[x] for x in f] for feats, _ in data for f in feats]
        flat, edge = np.concatenate(names), np.cumsum([0] + [len(x) for x in names])[:-1]
        own = np.repeat(np.arange(len(names)), [len(x) for x in names])
        gold = np.concatenate([g for _, g in data])
        barred, same = self.move < -1e6, np.zeros((3, 3))
        follows = np.concatenate([np.arange(k) > 0 for k in size])
        np.add.at(same, (gold[:-1][follows[1:]], gold[1:][follows[1:]]), 1)
        live = np.arange(t) < size[:, None]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in (self.emit, self.move)]
        for step in range(1, rounds + 1):
            s = np.zeros((n * t, 3))
            s[at] = np.add.reduceat(self.emit[flat], edge)
            s = s.reshape(n, t, 3)
            s[:, 0, I] = -1e9
            fwd, bwd = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            fwd[:, 0] = s[:, 0]
            for k in range(1, t):
                fwd[:, k] = np.where(live[:, k, None], s[:, k] + np.logaddexp.reduce(fwd[:, k - 1, :, None] + self.move, axis=1), fwd[:, k - 1])
            for k in range(t - 2, -1, -1):
                bwd[:, k] = np.where(live[:, k + 1, None], np.logaddexp.reduce(self.move + (s[:, k + 1] + bwd[:, k + 1])[:, None, :], axis=2), 0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            node = np.exp(fwd + bwd - z[:, None, None]).reshape(n * t, 3)[at]
            pair = np.exp(fwd[:, :-1, :, None] + self.move + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
            want = np.zeros((len(gold), 3))
            want[np.arange(len(gold)), gold] = 1
            want -= node
            d_emit = np.column_stack([np.bincount(flat, want[own, j], len(self.emit)) for j in range(3)]) / n - decay * self.emit
            d_move = (same - (pair * live[:, 1:, None, None]).sum((0, 1))) / n
            d_move[barred] = 0
            for w, d, (m, v) in zip((self.emit, self.move), (d_emit, d_move), state):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


class GapCodes(dict):
    def __missing__(self, gap: str) -> int:
        if len(self) > 10_000:
            self.clear()
        self[gap] = code = gap_of(gap)
        return code


GAP_CODES = GapCodes()


def joint_name(kind: int, near: int, gap: int) -> str:
    return f"k={kind}|c={near}|g={gap}"


def file_name(kind: int, file: int) -> str:
    return f"k={kind}|f={file}"


def features(text: str) -> list[list[str]]:
    """The names of each token's features; `Field.emissions` sums the same."""
    tokens, gaps = TOKEN.findall(text), [gap_of(g) for g in TOKEN.split(text)]
    names = [name_of(t) for t in tokens]
    file = file_of(gaps[: len(tokens)], "cue" in names)
    out = []
    for k, token in enumerate(tokens):
        near = 2 if k and names[k - 1] == "cue" else 1 if k > 1 and names[k - 2] == "cue" else 0
        kind = kind_of(token)
        each = [*shape(token), f"g={gaps[k]}", joint_name(kind, near, gaps[k]), file_name(kind, file)]
        if k:
            each.append(f"p1={names[k - 1]}")
        if k > 1:
            each.append(f"p2={names[k - 2]}")
        if k + 1 < len(tokens):
            each.append(f"n1={names[k + 1]}")
        out.append(each)
    return out


PROSE = "the is and for was of in to required optional authentication management configuration expired reset policy confidential administrator undefined string true false null none invalid changed service ring economy agent holder value house sector schools property investigation information ingredients questions performance manager generation sharing distribution important summer winter river rain garden mountain yellow window security encryption verification protected forgotten document community government development responsibility representatives well-known user-defined built-in sign-in must be kept safe never share your with anyone".split()


def examples(n: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with their secret spans, from a fixed seed."""
    r = random.Random(seed)
    letters, num = string.ascii_letters, string.digits
    alnum = letters + num
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randint(2, 11)))
    speech = ["th er an ing tion on re ed en le ou ai st or".split(), "sch ein ung keit lich ä ö ü ß pf tz ver ge be heit".split(), "é è ê ç eau eux tion ment que oi ou re ier".split(), "ción ado mente ñ í ó rr ll os as ez que ga".split()]
    tongue = r.choice(speech)
    pron = lambda: "".join(r.choice(tongue) for _ in range(r.randint(1, 5)))
    chars = lambda pool, a, b: "".join(r.choices(pool, k=r.randint(a, b)))
    said = lambda: r.choice([r.choice(PROSE), pron(), pron(), word()])
    part = lambda: r.choice([r.choice(PROSE)[:9], pron(), word()])

    def secret() -> str:
        return r.choice([
            lambda: chars(alnum, 12, 44) + chars(num, 1, 3), lambda: chars("0123456789abcdef", 20, 64), lambda: chars(alnum + "+/", 24, 60) + r.choice(["", "=", "=="]),
            lambda: r.choice(["ghp_", "gho_", "sk_live_", "sk-", "pk_live_", "xoxb-", "glpat-", "npm_", "AIza", "SG."]) + chars(alnum, 18, 40), lambda: "AKIA" + chars(string.ascii_uppercase + num, 12, 17),
            lambda: "eyJ" + chars(alnum + "_-", 16, 40) + "." + chars(alnum + "_-", 16, 40) + "." + chars(alnum + "_-", 16, 40),
            lambda: part().title() + chars(num, 1, 5) + chars("!#$%*?", 0, 2) + chars(alnum, 0, 6), lambda: part().title() + chars("!#$%&*+-_.", 1, 2) + part().title() + r.choice(["", "!", "$", "1"]),
            lambda: chars(string.ascii_lowercase, 12, 19), lambda: chars(letters, 10, 19), lambda: chars(alnum, 8, 16), lambda: chars(alnum + "!#$%&*+-_@", 10, 24), lambda: part() + chars(num, 2, 6),
        ])()

    def parts() -> str:
        return r.choice([lambda: " ".join(chars(string.ascii_uppercase + num, 4, 5) for _ in range(r.randint(3, 6))), lambda: " ".join(chars(num, 4, 6) for _ in range(r.randint(3, 6)))])()

    def other() -> str:
        return r.choice([
            lambda: chars(num, 1, 6), lambda: "+" + chars(num, 8, 13), lambda: f"+1 ({chars(num, 3, 3)}) {chars(num, 3, 3)}-{chars(num, 4, 4)}", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: ".".join(chars(num, 1, 3) for _ in range(4)), lambda: pron() + "." + chars(num, 2, 2) + "@" + word() + str(r.randint(1, 9)) + ".example.com", lambda: "https://" + word() + ".example.org/" + word() + "/" + chars(num, 1, 5) + r.choice(["", "?page=2"]),
            lambda: "v" + chars(num, 1, 2) + "." + chars(num, 1, 2), lambda: "-".join(chars(num, 4, 4) for _ in range(4)), lambda: " ".join(chars(num, 4, 4) for _ in range(4)), lambda: pron() * 3, lambda: chars(num, 14, 19), lambda: word() + chars(num, 1, 2),
            lambda: r.choice("#*=-_") * r.randint(3, 30), lambda: (word() + "-") * 3 + word(), lambda: pron() + r.choice(["***", "%%%", "$$$", "###", "&&&", "!!"]), lambda: pron().upper(), lambda: "/" + word() + "/" + word() + ".txt", lambda: word().title() + word().title(), lambda: word() + "_" + word(),
            lambda: "-".join(chars("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: r.choice(["MIT", "Apache-2.0", "GPL-3.0", "UTF-8", "ISO-8859-1", "x86_64"]), lambda: chars(num, 1, 3) + r.choice(["%", "px", "ms", "GB"]),
        ])()

    cue = lambda: r.choice(["password", "Password", "passwd", "pwd", "PWD", "secret", "token", "api_key", "API_KEY", "apiKey", "api-key", "client_secret", "clientSecret", "DB_PASSWORD", "AUTH_TOKEN", "access_key", "accessKey", "private_key", "credential", "passphrase", "bearer", "SECRET_KEY", "encryption_key", "smtp_pwd", "secret-key"])
    plain = lambda: r.choice(["host", "port", "user", "name", "version", "id", "path", "url", "type", "date", "commit", "uuid", "etag", "phone", "mail", "Note", "title", "timeout", "lang", "encoding", "size", "session", "level", word(), pron()])
    out = []
    for _ in range(n):
        text, spans, config = "", [], r.random() < 0.4
        tongue = r.choice(speech)
        loud, noisy, noise = r.random() < 0.1, r.random() < 0.1, r.choice(["***", "%%%", "$$$", "###", "&&&"])
        style = lambda w: w.upper() + "!!" if loud else w + noise if noisy else r.choice([str, str, str, str.title])(w)  # noqa: B023, E731

        def hidden(s: str) -> None:
            nonlocal text
            spans.append((len(text), len(text) + len(s)))  # noqa: B023
            text += s

        for _ in range(r.randint(2, 5)):
            if not config or r.random() < 0.3:
                text += " ".join(style(said()) + r.choice(["", "", "", "", ",", "."]) for _ in range(r.choice([1, 3, 6, 9, 25]))) + " "
            chance = r.random()
            if chance < 0.25:  # what prose and settings say after a cue
                text += r.choice([cue(), cue(), "key", "Private", "auth", "The password", "A token", "Secret", "code"]) + r.choice([" ", ": ", " ", "=", " = ", ' "', ":", " is "])
                text += " ".join(r.choice([str.lower, str.lower, str.title, str.upper])(r.choice(PROSE)) for _ in range(r.randint(1, 4))) + r.choice(["", ".", "\n", '"'])
            elif chance < 0.5:
                text += r.choice([cue(), cue(), cue(), "Authorization: Bearer", "Authorization: Basic", "export " + cue(), "my password", "the " + cue(), "use " + cue(), "--password", "-H Authorization: token"])
                text += r.choice(["=", "=", ": ", " = ", " ", '="', ': "', "='", " is ", ":", '": "', " -> ", "\n"])
                hidden(secret())
                text += r.choice(["", '"', "'", "\n", ";", ",", "."])
            elif chance < 0.56:
                text += r.choice(["passphrase: ", "recovery codes: ", "backup codes: ", "passphrase = ", 'passphrase="', "recovery codes\n"])
                hidden(parts())
                text += r.choice(["\n", '"', ";", ". "])
            elif chance < 0.62:  # without a cue, known by its beginning
                hidden(r.choice(["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_"]) + chars(alnum, 20, 40))
            elif config or chance < 0.72:
                text += plain() + r.choice(["=", ": ", " = ", '="', ": ", " "]) + r.choice([other, other, said])() + r.choice(["", '"', "\n"])
            else:
                text += " ".join(other() for _ in range(r.randint(1, 3)))
            text += r.choice(["\n", "\n", " "]) if config else r.choice([" ", " ", ". ", "\n"])
        out.append((text, spans))
    return out


def gold_labels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    out, held = [], None
    for m in TOKEN.finditer(text):
        inside = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        out.append(O if inside is None else I if inside == held else B)
        held = inside
    return out


@functools.cache
def trained() -> Field:
    data, index = [], {}
    for text, spans in examples():
        feats = features(text)
        data.append((feats, gold_labels(text, spans)))
        for names in feats:
            for name in names:
                index.setdefault(name, len(index))
    move = np.zeros((3, 3))
    move[O, I] = -1e9
    model = Field(index, np.zeros((len(index), 3)), move)
    model.fit(data)
    return model


def field_spans(text: str, model: Field) -> list[tuple[int, int]]:
    s, tokens, gaps = model.emissions(text)
    labels = model.labels(s)
    found = np.flatnonzero(labels)
    if not len(found):
        return []
    size = np.empty(2 * len(tokens) + 1, np.int64)
    size[0::2], size[1::2] = [len(g) for g in gaps], [len(t) for t in tokens]
    end = np.cumsum(size)
    out: list[list[int]] = []
    for k in found.tolist():
        a, b = int(end[2 * k]), int(end[2 * k + 1])
        if labels[k] == I and out:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def touches(base: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return any(s < b and a < e for s, e, _ in base)


def scan_text(text: str, model: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), sorted. The field adds spans that no base span touches."""
    base = base_spans(text)
    added = [(a, b, "crf") for a, b in field_spans(text, model) if not touches(base, a, b)]
    order = {k: n for n, k in enumerate((*KINDS, "crf"))}
    return base, sorted(base + added, key=lambda s: (s[0], order[s[2]]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base: array of (kind, start, end), spans: the same with those that the field adds."""
    model = trained()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            base, spans = [], []
            model.ready().trim()
            for text in batch.column(1):
                b, s = scan_text(text.as_py() or "", model)
                base.append([{"kind": k, "start": x, "end": y} for x, y, k in b])
                spans.append([{"kind": k, "start": x, "end": y} for x, y, k in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(spans, span)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of SCHEMA."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest_of(text: str | None) -> tuple[int, int, int, str]:
    """Brute force for tests: the base patterns as they are written, matches that fail dropped afterwards."""
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(ASSIGN.pattern, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    listed = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
    return (*(sum(k == kind for _, _, k in found) for kind in KINDS), hashlib.sha256(listed.encode()).hexdigest())
