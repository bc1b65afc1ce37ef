"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token of a text as the beginning of a secret, inside one, or
outside, from its shape, the words and marks beside it and features of the whole
text; Viterbi finds the best tags of the whole text, which is one chain: no
token is left out, whatever stands beside it. Clue words (password, token,
bearer, ...) are features; they are those of English, German, Spanish and French
(``CLUES``). A token is looked at whole, however long.

Most tokens can't be of a secret whatever their finer features are: bounds of
their scores, worked out in numpy from their own and their neighbours' texts,
tell so, and Viterbi runs on the others, between tokens that are outside on
every best path. The tags are those of Viterbi on all tokens (``Bounds``).

The field is trained here, on texts made from templates by a seeded rule: keys,
passwords, passphrases, key blocks and connection strings on the one side; on
the other prose that speaks of passwords and tokens, placeholders, code,
numbers, paths, versions, identifiers and checksums.

Spans of the patterns are always kept; the field's (kind ``crf``) are added
where they overlap none. A null text is the empty text. Each row gives a row:
repeated rows and ids alike. Texts of any length are scanned whole, in time in
proportion; memory holds one batch of texts and the tokens of one text.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import by_batch, table, texts, without

#: Base patterns; letters of the first one's keywords stand in either case.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
MARKED = re.compile("[:=]")

#: Words that speak of a secret, by language; a word of several parts (DB_PASSWORD, apiToken) is told by one of them.
CLUES = {
    "en": r"pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|(?:api|access|private|signing|encryption|license|account|shared)[ _-]?keys?|apikey|bearer|basic|auth(?:orization|entication)?|credentials?|creds?|key|pin",
    "de": r"passw(?:ort|orte|örter)|kennw(?:ort|orte|örter)|schlüssel|geheimnis|geheimzahl|zugangs(?:daten|code|schlüssel)",
    "es": r"contraseña|clave|secreto|credencial(?:es)?",
    "fr": r"(?<=mot de )passe|(?<=mots de )passe|clef|clé|jeton|secrète|identifiant",
}
CLUE = re.compile(rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:{'|'.join(CLUES.values())})s?(?![a-zäöüßñ])")
#: One of these stands in each clue word, in small letters.
CLUE_PARTS = ("pass", "pwd", "pw", "secr", "token", "key", "bearer", "basic", "auth", "cred", "pin", "kennw", "schlüssel", "geheim", "zugangs", "contraseña", "clave", "clef", "clé", "jeton", "identifiant")
#: Clue words of the other languages by their beginnings, and the English ones that they count as.
ALIKE = {"passwor": "password", "passwör": "password", "kennw": "password", "contraseña": "password", "passe": "password", "zugangsc": "password", "schlüssel": "key", "clave": "key", "clef": "key", "clé": "key", "zugangss": "key", "geheim": "secret", "secr": "secret", "jeton": "token", "zugangsd": "credentials", "credencial": "credentials", "identifiant": "credentials"}
#: Words between a clue and its secret.
LINKS = {"is", "was", "are", "ist", "lautet", "war", "es", "era", "est", "était"}
HARMLESS = re.compile("(?i)sha|md5|commit|digest|checksum|version|uuid|guid|isbn|issn|doi|order|invoice|phone|card|www|path|file|etag|image|build|revision|ticket|serial|page|date|room|flight")
#: A token: a run without white space, brackets, quotes and commas; colons and equals signs are tokens of their own, but for padding at the end.
#: White space (\s), spelt out: a class of single characters is a table.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = re.compile(rf"""[^{SPACES}:=,;"'`()<>\[\]{{}}|]+(?:={{1,2}}(?=[{SPACES},;"'`)>\]}}|]|$))?|[:=]""")
DIGIT, LETTER, TURN = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[a-z](?=[A-Z])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), ordered."""
    found = []
    if MARKED.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def looks_random(token: str) -> bool:
    """Letters and digits mixed, or letters whose case turns often."""
    if DIGIT.search(token):
        return bool(LETTER.search(token))
    return len(token) >= 20 and len(TURN.findall(token)) >= 4


def chains(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what the field reads as one chain: the whole text."""
    if text:
        yield 0, len(text)


#: A run of characters with padding behind it, and classes of characters: 1 is outside of tokens, 2 a token of its own.
PADDED = re.compile(rf"""[^{SPACES}:=,;"'`()<>\[\]{{}}|]={{1,2}}(?=[{SPACES},;"'`)>\]}}|]|$)""")
_CLASS = np.zeros(0x3002, np.uint8)
_CLASS[[c for c in range(0x3001) if re.match(f"""[{SPACES},;"'`()<>\\[\\]{{}}|]""", chr(c))]] = 1
_CLASS[[ord(":"), ord("=")]] = 2


def codes(text: str) -> np.ndarray:
    """Code points, and a space behind them."""
    return np.frombuffer(f"{text} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of a chain's tokens (``TOKEN``); a full stop at the end of one isn't of it."""
    if start or end < len(text) or "=" in text and PADDED.search(text):
        return [_stripped(text, *m.span()) for m in TOKEN.finditer(text, start, end)]
    code = codes(text)
    kind = _CLASS[np.minimum(code, 0x3001)]
    run, mark = kind == 0, kind == 2
    begin, stop = run | mark, (run | mark)[:-1]
    begin[1:] &= ~(run[1:] & run[:-1])
    stop = stop & ~(run[:-1] & run[1:])
    out = list(zip(np.flatnonzero(begin).tolist(), (ends := np.flatnonzero(stop) + 1).tolist(), strict=True))
    tail = code[ends - 1]
    for i in np.flatnonzero((tail == ord(".")) | (tail == ord("…"))).tolist():
        out[i] = _stripped(text, *out[i])
    return out


def _stripped(text: str, s: int, e: int) -> tuple[int, int]:
    while e - s > 1 and text[e - 1] in ".…":
        e -= 1
    return s, e


def shape(token: str) -> str:
    """Classes of characters, runs of one shortened to two; the first ten of these."""
    out: list[str] = []
    for c in token:
        if len(out) == 10:
            break
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def file_features(text: str) -> list[str]:
    """Of the whole text: is it like code or settings, how long are its lines."""
    n = max(1, len(text))
    code = sum(map(text.count, "={};<>")) / n
    return [f"code{min(4, int(code * 100))}", f"lines{min(5, (n // (1 + text.count(chr(10)))).bit_length() // 2)}"]


CONSONANTS = re.compile("(?i)[bcdfghjklmnpqrstvwxz]{5,}")
CLASSES = (str.islower, str.isupper, str.isdigit)
MARKS = (":", "=")
NEWLINE = re.compile("\n")


@lru_cache(1 << 15)
def _own(token: str) -> tuple[str, list[str]]:
    """A token's sort and the features of its own text."""
    head = token
    lower, upper, digit = (sum(map(f, head)) for f in CLASSES)
    other = len(head) - sum(map(str.isalnum, head))
    word = head.isalpha() and not (lower and upper and not head[1:].islower())
    kinds = f"{lower > 0:d}{upper > 0:d}{digit > 0:d}{other > 0:d}"
    turns = sum(f(a) != f(b) for f in (str.isdigit, str.isupper) for a, b in zip(head, head[1:], strict=False)) / len(head)
    length = "1 2 3 4 5 6 8 8 12 12 12 12 16 16 16 16".split()[len(head) - 1] if len(head) <= 16 else "24" if len(head) <= 24 else "40" if len(head) <= 40 else "99"
    sort = "mark" if head in MARKS else "word" if word and len(head) < 16 else f"{kinds}{'s' if len(head) < 6 else 'm' if len(head) < 16 else 'l'}"
    features = ["sort=" + sort, "kinds=" + kinds, "len=" + length, f"kl={kinds}{length}"]
    if sort == "mark":
        features.append("mark=" + head)
    elif sort == "word":
        features.append("w=" + head.lower())
        if CONSONANTS.search(head):
            features.append("rare")
    else:
        features += [
            "shape=" + shape(head), f"entropy={int(2 * _entropy(head))}", f"el={int(_entropy(head))}{length}", f"digits={int(5 * digit / len(head))}", f"turns={min(5, int(8 * turns))}", f"tl={min(5, int(8 * turns))}{length}", f"hex={bool(re.fullmatch('[0-9a-f]+|[0-9A-F]+', head))}{length}", "prefix=" + head[:3],
            f"stars={bool(re.search('[*]{3}|[.]{3}|xxx|XXX|[$][{]?', head))}", f"path={head.count('/') > 1}", f"dots={min(3, head.count('.'))}", f"at={'@' in head}", f"rare={bool(CONSONANTS.search(head))}", f"snake={bool(re.fullmatch('[A-Za-z]+([_-][A-Za-z]+)+', head))}",
        ]
    return sort, features


def _at(text: str, spans: list[tuple[int, int]], i: int, whole: list[str], far: int, bad: int, since: str, last: str, clue: bool, broken: bool) -> list[str]:
    """The features of token i, of which ``far``, ``bad``, ``since`` and ``last`` tell what came before."""

    def word(j: int, edge: str) -> str:
        return text[slice(*spans[j])].lower() if 0 <= j < len(spans) else edge

    def sort_of(j: int, edge: str) -> str:
        return _own(text[slice(*spans[j])])[0] if 0 <= j < len(spans) else edge

    s, e = spans[i]
    sort, mine = _own(text[s:e])
    before = text[s - 1 : s] if s and (not i or spans[i - 1][1] < s) else ""
    after = text[e : e + 1]
    quoted = before in ("'", '"', "`") and after == before
    place = f"{far}{since[-3:]}"
    f = [
        "bias", *mine, f"clue={clue}", f"place={place}", f"sp={sort}{place}", f"far={far}{sort}", f"no={min(bad, 3)}", f"ns={min(bad, 3)}{sort}", f"quoted={quoted}{sort}", f"next={after if after in ',.;' + chr(10) else '-'}", f"new={broken}{sort}",
        "w-1=" + word(i - 1, "^"), "w-2=" + word(i - 2, "^"), "w+1=" + word(i + 1, "$"), f"s-1={sort_of(i - 1, '^')}", f"s+1={sort_of(i + 1, '$')}",
        f"ss={sort_of(i - 1, '^')}{sort}{sort_of(i + 1, '$')}",
    ]
    if far < 9:
        f += [f"last={last}{sort}", f"lf={last}{min(far, 3)}{since[-3:]}", *[f"{w}{sort}" for w in whole]]
        f += [f"kp={mine[1]}{place}", f"lp={mine[2]}{place}", f"q={quoted}{place}{sort}"]
    return [*f, *whole]


#: What is known at a token of those before it: words since a clue and since a harmless one (9: many), marks since the clue, the clue.
State = tuple[int, int, str, str]
FAR: State = (9, 9, "-", "-")
#: A token's place, what is known there and behind it, is it a clue, does it begin a line.
Step = tuple[int, State, State, bool, bool]


def walk(text: str, spans: list[tuple[int, int]], marked: list[tuple[int, bool]]) -> list[Step]:
    """A step for each ``marked`` token: those that are more than a word to what follows (clues, harmless words, marks, links, first ones of a line), and whether they begin a line."""
    out: list[Step] = [(-1, FAR, FAR, False, False)]
    (far, bad, since, last), before = FAR, -1
    for i, broken in marked:
        s, e = spans[i]
        low = text[s:e].lower()
        clue, mark = CLUE.search(text, s, e), low in MARKS
        far, bad = min(9, far + i - before - 1), min(9, bad + i - before - 1)
        if broken and not clue:
            since = (since + "n")[-3:]
        here = far, bad, since, last
        far, bad = (0 if clue else min(9, far + (not mark))), (0 if HARMLESS.search(text, s, e) else min(9, bad + 1))
        if clue:
            since, last = "-", clue[0].lower()
            last = next((word for start, word in ALIKE.items() if last.startswith(start)), last)
        elif mark:
            since = (since + low)[-3:]
        elif far == 1 and low in LINKS:
            since = (since + "i")[-3:]
            far = 0
        out.append((i, here, (far, bad, since, last), bool(clue), broken))
        before = i
    return out


def chain_features(text: str, spans: list[tuple[int, int]], whole: list[str], wanted: list[int] | None = None, steps: list[Step] | None = None) -> list[list[str]]:
    """The features of each token of a chain, or of those ``wanted`` (ascending)."""
    steps = walk(text, spans, list(enumerate(_breaks(text, spans).tolist()))) if steps is None else steps
    out, at = [], 0
    for i in range(len(spans)) if wanted is None else wanted:
        while at + 1 < len(steps) and steps[at + 1][0] <= i:
            at += 1
        k, here, (far, bad, since, last), clue, broken = steps[at]
        if k == i:
            out.append(_at(text, spans, i, whole, *here, clue, broken))
        else:
            out.append(_at(text, spans, i, whole, min(9, far + i - k - 1), min(9, bad + i - k - 1), since, last, False, False))
    return out


def _breaks(text: str, spans: list[tuple[int, int]], ends: np.ndarray | None = None) -> np.ndarray:
    """Which tokens are the first ones of a line."""
    out = np.zeros(len(spans) + 1, bool)
    if "\n" in text:
        ends = np.fromiter([e for _, e in spans], np.int64, len(spans)) if ends is None else ends
        out[np.searchsorted(ends, [m.start() for m in NEWLINE.finditer(text)], "right")] = True
        out[0] = text[max(0, spans[0][0] - 1) : spans[0][0]] == "\n"
    return out[:-1]


B, I, O = 0, 1, 2  # noqa: E741


class Field:
    """Weights of features by tag, and of neighbouring tags; an inside tag follows a beginning or an inside one only."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.w = np.zeros((len(names), 3))
        self.t = np.zeros((4, 3))  # from B, I, O and the start

    def places(self, features: list[str]) -> list[int]:
        return [self.at[f] for f in features if f in self.at]

    def steps(self) -> np.ndarray:
        t = self.t.copy()
        t[O, I] = t[3, I] = -1e4
        return t

    def chain(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.w[p].sum(0) for p in rows]), self.steps()

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "bounds"}

    def decode(self, rows: list[list[int]], first: bool = True, last: bool = True) -> list[int]:
        """The best tags, by Viterbi; ``first`` and ``last``: whether the rows begin and end their chain or stand beside a token that is outside."""
        e, t = self.chain(rows)
        best, back = e[0] + t[3 if first else O], []
        for x in e[1:]:
            all_ = best[:, None] + t[:3]
            back.append(all_.argmax(0))
            best = all_.max(0) + x
        tags = [int((best if last else best + t[:3, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def gradient(self, e: np.ndarray, real: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of many chains: by chain, token and tag, and by pair of tags, from forward and backward sums.

        ``e``: (chains, tokens, 3); ``real``: which tokens are there, a chain's first ones.
        """
        t = self.steps()
        m, n, _ = e.shape
        f, b = np.zeros((m, n, 3)), np.zeros((m, n, 3))
        f[:, 0] = e[:, 0] + t[3]
        for i in range(1, n):
            f[:, i] = np.where(real[:, i, None], e[:, i] + np.logaddexp.reduce(f[:, i - 1, :, None] + t[:3], axis=1), f[:, i - 1])
        for i in range(n - 2, -1, -1):
            b[:, i] = np.where(real[:, i + 1, None], np.logaddexp.reduce(t[:3] + (e[:, i + 1] + b[:, i + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(f[:, -1], axis=1)
        d = -np.exp(f + b - z[:, None, None])
        own = np.eye(3)[tags]
        dt = np.zeros((4, 3))
        dt[3] = (own[:, 0] + d[:, 0]).sum(0)
        both = np.exp(f[:, :-1, :, None] + t[:3] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        pairs = own[:, :-1, :, None] * own[:, 1:, None, :]
        dt[:3] = ((pairs - both) * real[:, 1:, None, None]).sum((0, 1))
        return (d + own) * real[:, :, None], dt


LETTERS = "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"hex": "0123456789abcdef", "up": LETTERS.upper() + "0123456789", "low": LETTERS + "0123456789", "alnum": LETTERS + LETTERS.upper() + "0123456789", "letters": LETTERS + LETTERS.upper(), "small": LETTERS, "digits": "0123456789", "b64": LETTERS + LETTERS.upper() + "0123456789+/", "url": LETTERS + LETTERS.upper() + "0123456789-_", "mixed": LETTERS + LETTERS.upper() + "0123456789!@#$%^*?-_+"}
SYLLABLES = ("the on er th re an in tion es or un la de ment ou st ing ed le que ver ge sch ung en ci os do el mi as ar é ñe ü ça ba ko ri ta no su mo").split()


class Writer:
    """Texts with and without secrets, by a seeded rule. ``piece`` gives a text and the spans of the secrets there."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def one(self, *options: str) -> str:
        return self.rng.choice(options)

    def some(self, kind: str, lo: int, hi: int) -> str:
        return "".join(self.rng.choices(ALPHABETS[kind], k=self.rng.randint(lo, hi)))

    def word(self) -> str:
        w = "".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4)))
        return w.capitalize() if self.rng.random() < 0.12 else w

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(self.word() + (self.one(",", ".", "") if self.rng.random() < 0.2 else "") for _ in range(self.rng.randint(lo, hi)))

    def strong(self) -> str:
        """Random beyond doubt, whatever stands beside it."""
        r = self.rng.random()
        if r < 0.3:
            return self.some("alnum", 20, 44)
        if r < 0.45:
            return self.some("b64", 28, 60) + self.one("", "=", "==")
        if r < 0.6:
            return self.one("ghp_", "gho_", "sk-", "sk_live_", "pk_live_", "xoxb-", "glpat-", "npm_", "hf_", "SG.", "AIza", "shpat_") + self.some("alnum", 24, 40)
        if r < 0.7:
            return "eyJ" + self.some("alnum", 12, 30) + "." + self.some("url", 20, 60) + "." + self.some("url", 20, 43)
        return self.some(self.one("low", "url", "up"), 24, 40)

    def weak(self) -> str:
        """What only its context tells."""
        r = self.rng.random()
        if r < 0.25:
            return self.some(self.one("low", "alnum"), 6, 14)
        if r < 0.45:
            return self.some("mixed", 8, 18)
        if r < 0.6:
            w = self.word()
            return self.one(w, w.capitalize()) + self.one("", "@", "#", "_", "!", "$") + self.some("digits", 2, 5) + self.one("", "!", "!!", "$", "#")
        if r < 0.72:
            return self.some(self.one("letters", "small"), 12, 40)
        if r < 0.84:
            return self.some("digits", 8, 32)
        if r < 0.92:
            return "P" + self.one("@ss", "a$$", "4ss") + self.one("w0rd", "word", "phrase") + self.one("", "!", "@", "#") + self.some("digits", 1, 4) + self.one("", "!")
        return "-".join(self.some(self.one("up", "low"), 4, 6) for _ in range(self.rng.randint(2, 5)))

    def name(self) -> str:
        base = self.one("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access_token", "auth_token", "client_secret", "private_key", "secret_key", "credential", "auth", "passphrase", "signing_key", "refresh_token", "key", "pin", "api key", "access key")
        base = self.one("", "", "", "db_", "user_", "admin_", "AWS_", "my_", "app.", "smtp_") + base
        return self.one(base, base, base.upper(), base.title().replace("_", ""), base.capitalize())

    def hint(self) -> str:
        """What leads up to a secret."""
        if self.rng.random() < 0.2:
            return self.foreign_hint()
        n = self.name()
        return self.one(
            f"{n}=", f"{n}: ", f'{n} = "', f'"{n}": "', f"{n} = '", f"{n} is ", f"{n} ", f"export {n}=", f"--{n} ", f"--{n}=", f"the {n} is ", f"your {n}: ", f"{n}:", f"{n} -> ", f"set {n} to ", f"use {n} ", f"<{n}>", f"{n} := ", f"{n} was changed to ", f"with {n} ",
            "Authorization: Bearer ", "Authorization: Basic ", "auth ", "bearer ", "Bearer ", f"X-{n.title()}: ", f"login {self.word()} {n} ", f"{n}\n", "x-auth-token: ", "temporary password ", "one-time password: ", "?token=", "&key=", "?access_token=",
        )

    def foreign_name(self) -> tuple[str, str]:
        """A word for a secret in another language, and the language."""
        lang = self.one("de", "es", "fr")
        n = {"de": ("Passwort", "Passwort", "Kennwort", "Schlüssel", "Zugangscode", "passwort"), "es": ("contraseña", "contraseña", "clave", "clave de acceso", "credencial", "Contraseña"), "fr": ("mot de passe", "mot de passe", "clé", "jeton", "identifiant", "Mot de passe")}[lang]
        return self.one(*n), lang

    def foreign_hint(self) -> str:
        n, lang = self.foreign_name()
        own = {
            "de": ("das {n} lautet ", "{n} ist ", "mein {n}: ", "Ihr {n} lautet: ", "mit {n} ", "neues {n} ", "das {n} war ", "{n} für {w}: "),
            "es": ("la {n} es ", "tu {n}: ", "mi {n} es ", "con {n} ", "nueva {n} ", "la {n} era ", "{n} de {w}: "),
            "fr": ("le {n} est ", "votre {n} : ", "mon {n} est ", "avec {n} ", "nouveau {n} ", "le {n} était ", "{n} de {w} : "),
        }[lang]
        return self.one(*own, "{n}: ", "{n}=", "{n} = ", "{n} ").format(n=n, w=self.word())

    def foreign_plain(self) -> str:
        n, lang = self.foreign_name()
        own = {
            "de": ("das {n} wurde geändert", "{n} vergessen", "das {n} ist falsch", "der Schlüssel zum {w}", "das {n} muss {w} sein", "das {n} lautet anders", "ein sicheres {n} ist {w} {w}", "das Geheimnis von {w}"),
            "es": ("la {n} es obligatoria", "olvidé mi {n}", "la {n} del {w}", "la {n} es {w} {w}", "cambiar la {n} de {w}", "la clave del éxito", "el secreto de {w}"),
            "fr": ("{n} oublié", "le {n} est requis", "la clé du {w}", "le {n} est {w} {w}", "changer le {n} de {w}", "un {n} de {w}", "le secret de {w}"),
        }[lang]
        return self.one(*own, "{n}: {w} {w}", "{n} {w} {w}", "{n}").format(n=n, w=self.word())

    def hook(self) -> str:
        """An address whose path is the secret."""
        own = self.one(f"T{self.some('up', 8, 10)}/B{self.some('up', 8, 10)}/", f"{self.some('digits', 10, 18)}/", "")
        return f"//{self.one('hooks.', 'api.', 'webhook.', '')}{self.word()}.{self.one('com', 'io', 'org')}/{self.one('services', 'hooks', 'api/webhooks', 'v1/hook')}/{own}{self.some('alnum', 22, 40)}"

    def positive(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.rng.random()
        if r < 0.06:
            lead = f"-----BEGIN {self.one('RSA ', 'EC ', '', 'OPENSSH ')}PRIVATE KEY-----\n"
            body = "\n".join(self.some("b64", 64, 64) for _ in range(self.rng.randint(1, 4))) + "\n" + self.some("b64", 8, 60) + self.one("", "=", "==")
            return lead + body + "\n-----END PRIVATE KEY-----", [(len(lead), len(lead) + len(body))]
        if r < 0.12:
            lead = f"{self.one('postgres', 'mysql', 'https', 'redis', 'amqp', 'ftp', 'mongodb+srv')}://{self.one('admin', 'root', 'user', self.word())}:"
            key = self.one(self.weak(), self.strong()).replace("@", "x")
            return f"{lead}{key}@{self.word()}.{self.one('com', 'org', 'local', 'io')}:{self.some('digits', 4, 4)}/{self.word()}", [(len(lead), len(lead) + len(key))]
        if r < 0.22:
            lead = self.one("passphrase: ", "passphrase is ", 'passphrase = "', "passphrase='", 'PASSPHRASE="', "Passphrase ")
            key = " ".join("".join(self.rng.choices(SYLLABLES[:34], k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(4, 8))) 
            return lead + key + (lead[-1] + self.one("\n", ", ", " ") if lead[-1] in "\"'" else self.one("\n", "\n\n", ".\n")), [(len(lead), len(lead) + len(key))]
        if r < 0.26:
            key = self.hook()
            return "https:" + key, [(6, 6 + len(key))]
        if r < 0.36:
            key = self.strong() if self.rng.random() < 0.8 else "\n".join(self.some("b64", 64, 64) for _ in range(2))
            lead = self.one("", "", "my ", "curl -u admin:", "value ", "here it is: ", "line ", "use ", "\n")
            return lead + key, [(len(lead), len(lead) + len(key))]
        lead = self.hint()
        key = self.weak() if self.rng.random() < 0.6 else self.strong()
        close = {'"': '"', "'": "'", ">": "</"}.get(lead[-1], "")
        return lead + key + close + self.one("", "", ".", ",", ";", "\n"), [(len(lead), len(lead) + len(key))]

    def plain(self) -> str:
        """A token that looks odd and is no secret."""
        w, d = self.word, self.rng.randint
        return self.one(
            f"{d(1990, 2030)}-{d(10, 12)}-{d(10, 28)}T{d(10, 23)}:{d(10, 59)}", f"chapter_{d(1, 99)}_{w()}", f"{w()}/{w()}/{w()}{d(0, 9)}.html", f"{w()}-{w()}-{d(1, 999)}", f"v{d(0, 9)}.{d(0, 99)}.{d(0, 99)}-{w()}", f"{w()}{w()}{d(0, 99)}", f"img_{d(1000, 9999999)}.jpeg", f"{w()}.{w()}{d(1, 99)}",
            f"ORD-{d(10**7, 10**9)}-{self.one('A', 'B', 'C')}", f"{w()}.{d(1, 99)}@{w()}{d(1, 9)}.example", f"{d(1, 255)}.{d(1, 255)}.{d(1, 255)}.{d(1, 255)}", f"https://www.{w()}.com/{w()}/{d(1, 9999)}/{w()}-{w()}-{w()}", f"+{d(1, 99)} {d(100, 999)} {d(100, 999)}-{d(1000, 9999)}", f"{w()}_{w()}_{w()}", f"self.{w()}_{w()}({w()})",
            f"{d(10**3, 10**12)}", f"{w()}{w().capitalize()}{w().capitalize()}{w().capitalize()}", f"{w()}2{w()}", f"ISBN 978-{d(0, 9)}-{d(10, 99)}-{d(100000, 999999)}-{d(0, 9)}", "".join(self.word() for _ in range(6)), f"{w().upper()}-{d(100, 999)}", f"{w()}###", f"{d(10, 99)}th-{w()}",
        )

    def negative(self) -> str:
        r = self.rng.random()
        w, n = self.word, self.name()
        if self.rng.random() < 0.12:
            return self.foreign_plain()
        if r < 0.3:
            return self.one(
                f"the {n} was lost", f"forgot my {n} yesterday", f"{n} must be at least {self.rng.randint(6, 20)} characters", f"{n} expired on {self.plain()}", f"a {n} of {w()} {w()}", "the secret garden", "secret of the old house", "secrets of success", f"token ring {w()}", f"each token is {w()}", f"the key to {w()} is {w()}", f"piano key {w()}", f"key points: {w()} {w()}",
                f"access denied for {w()}", f"auth failed for user {w()}", "basic rules", "basic income", f"the author {w()} {w()}", f"pin the {w()} on {w()}", f"pass the {w()} to {w()}", f"pass rate: {self.rng.randint(1, 99)}", f"boarding pass {w()} {self.plain()}", f"{n}s are {w()}", f"keep the {n} safe", f"{n} policy", f"a strong {n} is {w()} {w()}", f"tokens: {self.rng.randint(1, 99999)}",
                f"next token {w()}", f"{n} authentication with {w()}", f"Key: {w()}", f"key = {w()}", f"key: {w()}_{w()}", f"primary key ({w()}_id)", f"token = next({w()})", f"Secret: {w()} {w()} {w()}", f"my {n} and {w()}", f"password reset link {w()}", f"enter your {n}: {w()} {w()}", f"{n} is required", f"{n} is not valid",
            )
        if r < 0.5:
            return f"{n}{self.one('=', ': ', ' = ', ': ' + chr(34))}" + self.one("null", "None", "true", "false", "********", "<your password>", "${DB_PASSWORD}", "$TOKEN", "xxxxxxxx", "{{ secret }}", "changeit", "os.environ['KEY']", "getenv(\"SECRET\")", "input()", "...", "", "string", "required", "%s", "REDACTED", f"config.{w()}", f"args.{w()}_{w()}", f"{w()}()", "str", "Optional[str]", "your_api_key", "<token>")
        if r < 0.6:
            return self.one("sha256: ", "md5 ", "commit ", "checksum ", "etag: ", "digest=", "uuid ", "build ", "file ") + self.one(self.some("hex", 7, 12), f"{self.some('hex', 8, 8)}-{self.some('hex', 4, 4)}-{self.some('hex', 4, 4)}-{self.some('hex', 4, 4)}-{self.some('hex', 12, 12)}", self.some("hex", 32, 40), f"{self.word()}-{self.some('low', 8, 20)}.js", self.plain())
        if r < 0.65:
            return "data:image/png;base64," + self.some("b64", 60, 120)
        return self.one("", "", "see ", "version ", "path: ", "id=", "at ", "page ", "order ", "invoice: ", "phone: ", "mail ", "date: ", "room ", "file ") + self.plain()

    def piece(self) -> tuple[str, list[tuple[int, int]]]:
        text, spans = self.prose(0, 14) + self.one(" ", "\n", ". "), []
        for _ in range(self.rng.randint(1, 3)):
            if self.rng.random() < 0.5:
                more, found = self.positive()
                spans += [(len(text) + a, len(text) + b) for a, b in found]
            else:
                more = self.negative()
            text += more + self.one(" ", "\n", ", ", ". ", " ") + self.prose(0, 12) + self.one(" ", "\n", ". ")
        return text, spans


def tagged(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Features and tags of each of a text's chains."""
    whole = file_features(text)
    for a, b in chains(text):
        parts = tokens(text, a, b)
        tags, inside = [], None
        for s, e in parts:
            own = next((k for k, (x, y) in enumerate(spans) if x < e and s < y), None)
            tags.append(O if own is None else I if own == inside else B)
            inside = own
        if parts:
            yield chain_features(text, parts, whole), tags


def train(seed: int = 11, n: int = 2400, epochs: int = 8, rate: float = 0.25, decay: float = 2e-4, batch: int = 48) -> Field:
    """The field, by gradient steps scaled by the squared gradients so far."""
    writer = Writer(seed)
    data = [x for _ in range(n) for x in tagged(*writer.piece())]
    seen = Counter(f for rows, _ in data for r in rows for f in r)
    field = Field(sorted(f for f, k in seen.items() if k > 2))
    data = [([np.array(field.places(r)) for r in rows], tags) for rows, tags in data]
    gw, gt = np.full(field.w.shape, 1e-1), np.full(field.t.shape, 1e-1)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        data.sort(key=lambda x: len(x[1]) // 8)
        blocks = [data[i : i + batch] for i in range(0, len(data), batch)]
        rng.shuffle(blocks)
        for block in blocks:
            longest = max(len(tags) for _, tags in block)
            real = np.array([[i < len(tags) for i in range(longest)] for _, tags in block])
            tags = np.array([[*tags, *[O] * (longest - len(tags))] for _, tags in block])
            sizes = np.array([len(p) for rows, _ in block for p in rows])
            places = np.concatenate([p for rows, _ in block for p in rows])
            e = np.zeros((*real.shape, 3))
            e[real] = np.add.reduceat(field.w[places], np.cumsum(sizes) - sizes)
            d, dt = field.gradient(e, real, tags)
            each = np.repeat(d[real], sizes, axis=0)
            used, at = np.unique(places, return_inverse=True)
            g = np.stack([np.bincount(at, each[:, k], len(used)) for k in range(3)], axis=1) - decay * len(block) * field.w[used]
            gw[used] += g * g
            field.w[used] += rate * g / np.sqrt(gw[used])
            gt += dt * dt
            field.t += rate * dt / np.sqrt(gt)
    return field


#: Words in small letters that may be clues, harmless ones or links hold one of these.
TOLD = re.compile("|".join([*CLUE_PARTS, HARMLESS.pattern.removeprefix("(?i)"), *(f"^{x}$" for x in LINKS)]))


class Bounds:
    """What tokens can score at most as the beginning (column 0) or the inside (1) of a secret, more than outside.

    A secret of a best path scores, from any of its tokens to its end, no less than
    if these tokens were outside. So the bounds of its tokens, added up from its
    end, with the most that tags of neighbours can add, never fall below zero:
    tokens that are in no such row are outside.

    Far from clues the bounds are the scores themselves, looked up by the tokens'
    texts, sorts and marks; near to clues the best of some features is taken.
    """

    #: Texts of tokens that are kept; when there are more, it begins anew.
    KEPT = 1 << 19
    CLUE, NO, MARK, LINK = 1, 2, 4, 8

    def __init__(self, field: Field):
        self.at, t = field.at, field.steps()
        self.gain = np.ascontiguousarray((field.w - field.w[:, [O]])[:, :2])
        self.none = np.zeros(2)
        # What the way into a tag can add, and the way out of the last one.
        self.into = np.array([max((t[x, y] - min(t[x, O], t[O, O])) for x in range(4) if t[x, y] > -1e3) for y in (B, I)])
        self.out = max(0.0, max(t[x, y] - t[O, y] for x in (B, I) for y in (B, O)))
        names = list(self.at)
        # Sorts: 0 is the edge of a text, 1 any that the field hasn't seen. Marks since a clue: 0 is what it hasn't seen.
        kinds = ["^", "", *(n[5:] for n in names if n.startswith("sort="))]
        since = ["", *sorted({n[7:] for n in names if n.startswith("place=9")})]
        self.sorts, self.since = {x: k for k, x in enumerate(kinds) if k > 1}, {x: k for k, x in enumerate(since) if k}
        after = ["$", *kinds[1:]]
        self.three = np.array([[[self.of(f"ss={a}{b}{c}") for c in after] for b in kinds] for a in kinds])
        self.place = np.array([[self.of(f"place=9{x}") + self.of(f"sp={a}9{x}") if x else self.none for x in since] for a in kinds])
        self.bad = np.array([[self.of(f"no={x}") + self.of(f"ns={x}{a}") for x in range(4)] for a in kinds])
        self.quoted, self.new = (np.array([[self.of(f"{h}={x}{a}") for x in (False, True)] for a in kinds]) for h in ("quoted", "new"))
        self.next = np.array([self.of(f"next={x}") for x in ("-", *",.;\n", "")])
        most = sum(np.max([self.none, *(self.of(n) for n in names if n.startswith(h))], axis=0) for h in ("place=", "sp=", "far=", "last=", "lf=", "kp=", "lp=", "q=", "code", "lines"))
        self.near = most + self.bad.max(1) + self.quoted.max(1) + self.new.max(1) + self.next.max(0)
        self.known = {n.partition("=")[2] for n in names if n.startswith(("w=", "w-1=", "w-2=", "w+1="))}
        self.clear()

    def of(self, name: str) -> np.ndarray:
        k = self.at.get(name)
        return self.none if k is None else self.gain[k]

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[tuple, int] = {}
        self.n = 0
        self.rows = np.zeros((1024, 4, 2))  # itself, and as the one before, the one but one before, the next
        self.sort = np.zeros(1024, np.int64)
        self.flags = np.zeros(1024, np.uint8)
        self.put(np.array([self.none, self.of("w-1=^") + self.of("s-1=^"), self.of("w-2=^"), self.of("w+1=$") + self.of("s+1=$")]), 0, 0)

    def put(self, row: np.ndarray, sort: int, flags: int) -> int:
        k = self.n
        if k == len(self.flags):
            for name in ("rows", "sort", "flags"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.rows[k], self.sort[k], self.flags[k] = row, sort, flags
        self.n += 1
        return k

    def add(self, token: str) -> int:
        """The row of a token's text. Words that the field has no weight for, and that are no clues or the like, share rows."""
        low = token.lower()
        small = token.islower()
        word = token.isalpha() and len(token) < 16 and (small or token.isupper() or token[0].isupper() and token[1:].islower())
        told = low in self.known
        plain = word and not told and not TOLD.search(low) and not any(c in token for c in "ſİı")
        like = (small, not small and token.isupper(), len(token), CONSONANTS.search(token) is not None) if plain else None
        k = self.words.get(like) if plain else None
        if k is None:
            row, sort = self.of_token(*_own(token))
            if told:
                row[1:] += [self.of(h + low) for h in ("w-1=", "w-2=", "w+1=")]
            maybe = any(p in low for p in CLUE_PARTS) or any(c in token for c in "ſİı")  # letters that count as s and i
            k = self.put(row, sort, self.CLUE * maybe + self.NO * (HARMLESS.search(token) is not None) + self.MARK * (token in MARKS) + self.LINK * (low in LINKS))
            if plain:
                self.words[like] = k
        self.ids[token] = k
        return k

    def of_token(self, sort: str, mine: list[str]) -> tuple[np.ndarray, int]:
        """A row without what is told by the neighbours' words, and the sort."""
        own = [self.at[f] for f in ("bias", "clue=False", f"far=9{sort}", *mine) if f in self.at]
        return np.array([self.gain[own].sum(0), self.of("s-1=" + sort), self.none, self.of("s+1=" + sort)]), self.sorts.get(sort, 1)

    def open(self, text: str, spans: list[tuple[int, int]], whole: list[str]) -> tuple[list[int], list[Step]]:
        """The tokens that may be of a secret, and the steps by which ``chain_features`` knows their places."""
        if len(self.ids) > self.KEPT:
            self.clear()
        ids, add, n = self.ids, self.add, len(spans)
        own = np.zeros(n + 3, np.int64)
        own[2:-1] = [ids[w] if (w := text[s:e]) in ids else add(w) for s, e in spans]
        x, sort = own[2:-1], self.sort[own]
        mine = sort[2:-1]
        most = self.rows[x, 0] + self.rows[own[1:-2], 1] + self.rows[own[:-3], 2] + self.rows[own[3:], 3] + self.three[sort[1:-2], mine, sort[3:]]
        most += sum(map(self.of, whole), self.none) + self.into

        s, e = np.fromiter(chain.from_iterable(spans), np.int64, 2 * n).reshape(-1, 2).T
        flags, breaks = self.flags[x], _breaks(text, spans, e)
        marked = np.flatnonzero((flags > 0) | breaks)
        steps = walk(text, spans, list(zip(marked.tolist(), breaks[marked].tolist(), strict=True)))
        place = np.array([p[0] for p in steps])
        at = np.searchsorted(place, np.arange(n), "right") - 1
        further = np.arange(n) - place[at] - 1
        far, bad, since = (np.array(v)[at] for v in zip(*[(p[2][0], p[2][1], self.since.get(p[2][2], 0)) for p in steps], strict=True))
        far, bad = far + further, bad + further
        far[marked], bad[marked], since[marked] = np.array([(p[1][0], p[1][1], self.since.get(p[1][2], 0)) for p in steps[1:]], np.int64).reshape(-1, 3).T
        near = far < 9
        near[marked] |= np.array([p[3] for p in steps[1:]], bool)

        code = codes(text)
        before, after = code[s - 1], code[e]
        quoted = (s > 0) & (before == after) & ((before == 34) | (before == 39) | (before == 96))
        following = sum((after == ord(c)) * k for k, c in enumerate(",.;\n", 1))
        following[e == len(text)] = 5
        known = self.place[mine, since] + self.bad[mine, np.minimum(bad, 3)] + self.quoted[mine, quoted.astype(int)] + self.new[mine, breaks.astype(int)] + self.next[following]
        if near.any():
            clue = np.maximum(self.of("clue=True") - self.of("clue=False"), 0)
            known[near] = self.near[mine[near]] + clue - [self.of(f"far=9{_own(text[slice(*spans[i])])[0]}") for i in np.flatnonzero(near).tolist()]
        most += known

        may = np.zeros(n, bool)
        for j in np.flatnonzero((most > -self.out - 1e-6).any(1))[::-1].tolist():
            left = self.out
            while j >= 0 and not may[j]:
                may[j] = most[j, 0] + left >= -1e-6
                left += most[j, 1]
                if left < -1e-6:
                    break
                may[j] = True
                left, j = max(left, self.out), j - 1
        return np.flatnonzero(may).tolist(), steps


def crf_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans from a beginning to the last inside token after it."""
    if "bounds" not in vars(field):
        field.bounds = Bounds(field)
    found: list[tuple[int, int]] = []
    for a, b in chains(text):
        parts = tokens(text, a, b)
        if not parts:
            continue
        whole = file_features(text)
        wanted, steps = field.bounds.open(text, parts, whole)
        rows = [field.places(f) for f in chain_features(text, parts, whole, wanted, steps)]
        i = 0
        while i < len(wanted):
            j = i + 1
            while j < len(wanted) and wanted[j] == wanted[j - 1] + 1:
                j += 1
            tags = field.decode(rows[i:j], wanted[i] == 0, wanted[j - 1] == len(parts) - 1)
            for k, tag in zip(wanted[i:j], tags, strict=True):
                if tag == B:
                    found.append(parts[k])
                elif tag == I:
                    found[-1] = (found[-1][0], parts[k][1])
            i = j
    return found


SPANS = "array<struct<kind:string,start:long,end:long,text:string>>"


def find_secrets(df: DataFrame, field: Field | None = None, *, text: str = "text") -> DataFrame:
    """``df`` with the column ``secrets`` (replaced, if there): kind, start, end in code points, text; by start, then kind."""
    keep = without(df, "secrets")
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    shared = df.sparkSession.sparkContext.broadcast(field or train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in texts(b.column(at)):
            base = base_spans(t)
            more = [(s, len(KINDS), e) for s, e in crf_spans(t, shared.value)]
            if base and more:
                more = [m for m in more if not any(x[0] < m[2] and m[0] < x[2] for x in base)]
            names = (*KINDS, "crf")
            out.append([{"kind": names[k], "start": s, "end": e, "text": t[s:e]} for s, k, e in sorted(base + more)])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*keep, "secrets"])

    return by_batch(df, scan, df.withColumn("secrets", F.array().cast(SPANS)).schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the hash is over the base kinds."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *[_count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
