"""Credentials embedded in source code (problem 5): find them in shown file contents and redact them.

Every literal with a name or a telling place (address, query, flag, header) is a candidate. Weak labels come from pattern matches; on
all labelled candidates of all reads a logistic regression is trained over the likelihood of the value's characters under a Markov
model of the corpus, the words around it and its path, and calibrated on the same. Candidates with a high score are found.

Training is a series of sums: workers write the candidates and count pairs of characters in one pass over the reads, equal candidates
become one row of features with their number, and each Newton step adds up gradients and Hessians over those rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.plans.runtime import cut, spread

#: Calibrated probability from which a candidate is a credential.
THRESHOLD = 0.5
MASK = "REDACTED"

_NAME = r"[A-Za-z_][\w.\-]*"
_VALUE = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
_ASSIGN = re.compile(rf"""(?P<q>["'])?(?P<name>{_NAME})(?(q)(?P=q))\s*(?:\[\s*\]\s*)?(?::\s*&?(?:'static )?\w+\s*)?(?:=>|:=|==?|:)\s*(?P<value>{_VALUE}(?:\s*[+.]\s*{_VALUE})*)""")
_BARE = re.compile(rf"^\s*(?:export\s+)?(?P<name>{_NAME})\s*(?:=|:\s)\s*(?P<value>[^\s\"'`(\[{{][^\n]*?)\s*$")
_USERINFO = re.compile(r"\b[a-z][a-z0-9+.\-]*://(?P<user>[^\s/:@\"'`]*):(?P<value>[^\s/\"'`]+)@[\w\-.\[]")
_QUERY = re.compile(r"[?&](?P<name>[A-Za-z_][\w.\-]*)=(?P<value>[^&\s\"'`#<>]+)")
_FLAG = re.compile(r"(?:(?<=\s)|(?<=[\"'`]))(?:--(?P<name>[a-z][\w\-]*)(?:=|\s+)(?P<value>[^\s\"'`]+)|-p(?P<space>\s+)?(?P<v2>[^\s\"'`\-=][^\s\"'`]*)|-u\s+(?P<user>[^\s:\"'`]+):(?P<v3>[^\s\"'`]+))")
#: Commands of which -p names a password.
_CLIENT = re.compile(r"(?i)\b(?:log_?in|mysql\w*|mariadb\w*|psql|mongo\w*|sshpass|htpasswd|ldap\w+|smbclient|ftp|connect|auth\w*|vpn)\b")
_HEADER = re.compile(r"(?P<name>[Bb]earer|[Bb]asic|[Tt]oken|\b[Xx]-[A-Za-z\-]+:|[Aa]uthorization:)\s+(?P<value>[A-Za-z0-9][\w\-.~+/=]{7,})")
_VENDOR = r"(?:gh[a-z]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[a-z]-[\w\-]{16,}|AKIA[A-Z0-9]{12,}|glpat-[\w\-]{20,}|sk-(?:[a-z]+-)?[A-Za-z0-9_\-]{20,}|[a-z]{2,5}-[0-9a-f]{8}-[A-Za-z0-9]{16,}|eyJ[\w\-=]{8,}\.[\w\-=]{6,}\.[\w\-=]{8,})"
_FREE = re.compile(rf"(?<![\w/+\-])(?P<value>{_VENDOR})(?![\w/+])")
_REMARK = re.compile(r"^\s*(?://+|#+|\*|/\*+|--)\s*(?P<text>.*)$")
_REMARK_VALUE = re.compile(r"(?<![^\s('\"`])(?=\S*\d)(?P<value>[A-Za-z0-9][^\s'\"`,;()]{7,})")
_GIVING = re.compile(r"(?i)login|logon|still valid|rotat|pass(?:word|wd|phrase)|token|secret|cred|api.?key|\bold one\b|\bwas\b|before the move|\btmp\b|temporar")
_TELLING_OF = re.compile(r"(?i)digest|schema|upstream|copyright|created|generated|source|version|\btag\b|licen[cs]e|commit|revision|checksum|see |https?:")
#: What every expression above but those of remarks needs at least one of.
_QUICK = re.compile(r"[=:\"'`_]|[Bb]earer|[Bb]asic|[Tt]oken|--|-p|-u|-[0-9a-f]{8}-|eyJ|AKIA|xox|glpat-|sk-")
_LINE = re.compile(r"(\d+): ?(.*)", re.S)

_BEGIN_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END_KEY = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_OTHER_PEM = re.compile(r"-----(?:BEGIN|END) (?!(?:[A-Z0-9]+ )*PRIVATE KEY)[A-Z0-9 ]+-----")
_KEY_LINE = re.compile(r"^\s*(?:(?://|#|\*|--|;|\")\s*)?(?P<value>[A-Za-z0-9+/=]{40,76}|[A-Za-z0-9+/]{1,76}={0,2})(?:\\n)?[\",]*\s*$")

_SECRETISH = re.compile(r"(?i)pass(?!port|ive|age|ing|ed|es$)|pwd|secret|token|api_?-?key|access_?-?key|signing_?-?key|private_?-?key|(?<![a-z])key$|bearer|auth|cred|(?<![a-z])(?:sig|code)$")
_PASSWORDISH = re.compile(r"(?i)pass(?!port|ive|age|ing|ed|es$)|pwd")
_DESCRIBING = re.compile(r"(?i)policy|label|kind|name|field|hint|type|format|prompt|title|ttl|length|limit|count|file|path|_env$|header$|rule|page|max|len$|placeholder|message")
_HASHISH = re.compile(r"(?i)sha_?\d+|(?:^|[_.\-])sha$|hash|digest|checksum|integrity|revision|commit|etag|md5|fingerprint|uuid|guid|trace|request_?id|_id$|(?<=[a-z])Id$|base_?ref|alphabet|icon|image|cert|public|version|resolved|(?:^|_)rev$")
_PLACEHOLDER = re.compile(r"(?i)^(?:change_?-?me.*|replace_?-?(?:me|this).*|<[^>]*>|\[[^\]]*\]|\$\{?[^}]*\}?|\{\{.*\}\}|%\w+%|x{3,}|\*{3,}|\.{3,}|(?:your|my|the|some)[\-_ ].*|todo.*|tbd|none|null|nil|undefined|example.*|dummy.*|redacted|secret|pass(?:word|wd)?|pwd|token|(?:vault|env|ssm|file|secretsmanager|keyring|arn|op|sops|kms)[:/].*|process\.env.*|os\.environ.*|enter .*|insert .*)$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_HEX = re.compile(r"(?i)^[0-9a-f]{16,}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|sri)[-:]|^data:|^(?:https?|git|ssh|postgres|mysql|redis|amqps?|mongodb(?:\+srv)?)://|^[\w.\-]+/[\w.\-/]+\.\w{1,5}$|^\.{0,2}/")
_ORDERED = re.compile(r"(?i)abcdefgh|0123456|hijkmn")
_WORDS = re.compile(r"^[a-z]+(?:[-_ .][a-z]+)*$|^[A-Z][a-z]+(?: [a-z]+)*$")
_CALL = re.compile(r"^[\w.]+(?:\[|\(|::)|^[\w.]+\.\w+\.\w+$")
_VENDOR_FULL = re.compile(_VENDOR)

PLACES = ("assign", "bare", "userinfo", "query", "flag", "header", "free", "remark")


class Candidate:
    __slots__ = ("place", "name", "value", "start", "end", "comment")

    def __init__(self, place: str, name: str, value: str, start: int, end: int, comment: bool) -> None:
        self.place, self.name, self.value, self.start, self.end, self.comment = place, name, value, start, end, comment


def _joined(text: str) -> str:
    """The content of one literal or of several joined ones."""
    return "".join(x[1:-1] for x in re.findall(_VALUE, text))


def candidates(line: str) -> list[Candidate]:
    """Literals of a line that have a name or a telling place; of overlapping ones the more telling place counts."""
    comment = bool(re.match(r"\s*(?://|#|\*|/\*|--)", line))
    if not comment and not _QUICK.search(line):
        return []
    found: list[Candidate] = []

    def add(place: str, name: str, value: str, span: tuple[int, int]) -> None:
        if value and not any(c.start < span[1] and span[0] < c.end for c in found):
            found.append(Candidate(place, name, value, *span, comment))

    # each search only where its characters are
    if "://" in line and "@" in line:
        for m in _USERINFO.finditer(line):
            add("userinfo", m.group("user"), m.group("value"), m.span("value"))
    for m in _HEADER.finditer(line):
        add("header", m.group("name"), m.group("value"), m.span("value"))
    if "=" in line and ("?" in line or "&" in line):
        for m in _QUERY.finditer(line):
            add("query", m.group("name"), m.group("value"), m.span("value"))
    if "--" in line or "-p" in line or "-u" in line:
        for m in _FLAG.finditer(line):
            if m.group("value") is not None:
                add("flag", m.group("name"), m.group("value"), m.span("value"))
            elif m.group("v2") is not None:
                client = _CLIENT.search(line, 0, m.start())
                if client or m.group("space"):  # of other commands -p may be anything, and without a space it is a bundle of flags
                    add("flag", "password" if client else "p", m.group("v2"), m.span("v2"))
            else:
                add("flag", "password", m.group("v3"), m.span("v3"))
    if ("=" in line or ":" in line) and ('"' in line or "'" in line or "`" in line):
        for m in _ASSIGN.finditer(line):
            add("assign", m.group("name"), _joined(m.group("value")), m.span("value"))
    if not found and ("=" in line or ":" in line) and (m := _BARE.match(line)):
        add("bare", m.group("name"), m.group("value"), m.span("value"))
    if "_" in line or "-" in line or "AKIA" in line or "eyJ" in line:
        for m in _FREE.finditer(line):
            add("free", "", m.group("value"), m.span("value"))
    if comment and (m := _REMARK.match(line)) and " " in m.group("text"):
        start = m.start("text")
        for v in _REMARK_VALUE.finditer(m.group("text")):
            rest = m.group("text")[: v.start()] + m.group("text")[v.end() :]
            name = "told_digest" if _TELLING_OF.search(rest) else "told_secret" if _GIVING.search(rest) else "told"
            add("remark", name, v.group("value"), (start + v.start("value"), start + v.end("value")))
    return found


class Markov:
    """Mean log-likelihood of a text's characters, each given the one before, with smoothing over a small alphabet."""

    def __init__(self, pairs: np.ndarray) -> None:
        table = pairs.reshape(128, 128)
        self.log = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 64)).tolist()

    def __call__(self, text: str) -> float:
        before, total = 32, 0.0
        for x in text:
            c = min(ord(x), 127)
            total += self.log[before][c]
            before = c
        return total / max(1, len(text))


class Pairs:
    """How often each character follows each other one in texts that spaces part; the counts of several can be added."""

    def __init__(self) -> None:
        self.counts, self.texts, self.size = np.zeros(128 * 128, np.int64), [], 0

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text) + 1
        if self.size > 1 << 20:
            self.total()

    def total(self) -> np.ndarray:
        if self.texts:
            c = np.minimum(np.frombuffer((" " + " ".join(self.texts) + " ").encode("utf-32-le", "replace"), np.uint32), 127).astype(np.int64)
            self.counts += np.bincount(c[:-1] * 128 + c[1:], minlength=128 * 128)
            self.texts, self.size = [], 0
        return self.counts


#: Share of changes between capitals, small letters and digits from which a text is no word.
MIXED = 0.3


def _switches(v: str) -> float:
    return sum((a.isupper(), a.isdigit()) != (b.isupper(), b.isdigit()) for a, b in zip(v, v[1:])) / max(1, len(v))


_SETTINGS = ("env", "ini", "cfg", "properties", "staging", "yml", "toml", "json")


def _ext(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def telling_path(path: str | None) -> str:
    """A short path with the same features."""
    path = path or ""
    return ("test" if "test" in path.lower() else "") + (f".{_ext(path)}" if _ext(path) in _SETTINGS else "")


def features(c: Candidate, path: str, markov: Markov) -> list[float]:
    v, n = c.value, len(c.value)
    classes = [any(x.islower() for x in v), any(x.isupper() for x in v), any(x.isdigit() for x in v), any(not x.isalnum() for x in v)]
    counts = Counter(v)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    digits = sum(x.isdigit() for x in v)
    switches = _switches(v)
    secret, describing, hashish = bool(_SECRETISH.search(c.name)), bool(_DESCRIBING.search(c.name)), bool(_HASHISH.search(c.name))
    placeholder, words = bool(_PLACEHOLDER.match(v)), bool(_WORDS.match(v))
    likely = markov(v)
    telling = c.place in ("userinfo", "header") or c.place == "flag" and bool(_PASSWORDISH.search(c.name))
    random = n >= 16 and " " not in v and classes[2] and likely < -3.2 and not _UUID.match(v) and not _DIGEST.match(v) and not _ORDERED.search(v)
    return [
        1.0, likely, entropy / 5, min(n, 64) / 32, digits / n, switches, float(sum(classes)) / 4, float(classes[2]), float(" " in v), float(secret), float(describing), float(hashish),
        float(placeholder), float(words), float(telling), float(bool(_UUID.match(v))), float(bool(_HEX.match(v))), float(bool(_DIGEST.match(v))), float(bool(_ORDERED.search(v))),
        float(bool(_PASSWORDISH.search(c.name))), float(secret and not describing and (sum(classes) >= 3 or switches > MIXED) and n >= 8 and " " not in v and not placeholder), float(re.fullmatch(r"[\d.]+", v) is not None), float(bool(_CALL.search(v))), float(describing and re.fullmatch(r"[a-z0-9]+(?:[-_.][a-z0-9]+)*", v) is not None), float(describing and secret), float(secret and classes[2] and not placeholder and not words and " " not in v), float(hashish and (random or bool(_HEX.match(v)))), float(random),
        float(telling and not placeholder), float(secret and placeholder), float(c.comment), float(bool(_VENDOR_FULL.search(v))),
        float(n < 7), float(_ext(path) in _SETTINGS), float("test" in path.lower()), *[float(c.place == p) for p in PLACES],
    ]


def weak_label(c: Candidate) -> int | None:
    """1 or 0 where a pattern settles it, None where only the model can tell."""
    v = c.value
    if _PLACEHOLDER.match(v) or _UUID.match(v) or _ORDERED.search(v) or " " in v:
        return 0
    vendor = _VENDOR_FULL.search(v)
    if vendor and not _HASHISH.search(c.name):
        return 1
    if _DIGEST.match(v) or _WORDS.match(v) or _HASHISH.search(c.name) or re.fullmatch(r"\d{1,12}|\d+\.\d+", v) or _CALL.search(v):
        return 0
    if _DESCRIBING.search(c.name) and re.fullmatch(r"[a-z0-9]+(?:[-_.][a-z0-9]+)*", v):
        return 0
    digit, kinds = any(x.isdigit() for x in v), sum((any(x.islower() for x in v), any(x.isupper() for x in v), any(x.isdigit() for x in v), any(not x.isalnum() for x in v)))
    if c.place == "remark":
        return 0 if c.name != "told_secret" or kinds < 2 or re.search(r"\d-\d\d-\d|^v?\d+(?:\.\d+)+", v) else 1
    if c.place in ("userinfo", "header") or c.place == "flag" and c.name == "password":
        return 1 if len(v) >= 6 else None
    if _PASSWORDISH.search(c.name) and not _DESCRIBING.search(c.name):
        return 1 if digit and kinds >= 2 and len(v) >= 6 or (kinds >= 3 or _switches(v) > MIXED) and len(v) >= 8 else 0 if not digit and kinds < 3 else None
    if _SECRETISH.search(c.name) and not _DESCRIBING.search(c.name):
        return 1 if digit and len(v) >= 16 else 0 if len(v) < 12 and not digit else None
    if c.place in ("assign", "bare") and len(v) >= 20 and kinds >= 3 and re.fullmatch(r"[\w+/=\-]+", v) and not _DESCRIBING.search(c.name):
        return 1  # a random text under a name that says nothing
    return 0 if len(v) < 12 or not digit else None


class Model:
    """Standardised logistic regression with a calibrating step."""

    def __init__(self, weights: list[float], mean: list[float], scale: list[float], calibration: tuple[float, float], markov: Markov) -> None:
        self.weights, self.mean, self.scale, self.calibration, self.markov = np.array(weights), np.array(mean), np.array(scale), calibration, markov

    def score(self, found: list[Candidate], path: str) -> np.ndarray:
        """Calibrated probability of each candidate."""
        return self.scores([(c, path) for c in found])

    def scores(self, found: list[tuple[Candidate, str]]) -> np.ndarray:
        """Calibrated probability of each (candidate, path)."""
        x = (np.array([features(c, path, self.markov) for c, path in found]) - self.mean) / self.scale
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * (x @ self.weights) + b, -40, 40)))


#: Adds up what a function gives for chunks of all rows (features, labels, numbers); None without rows.
Sums = Callable[[Callable[..., np.ndarray]], np.ndarray | None]


def _moments(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Number of candidates and of those labelled 1, then the sums of the features and of their squares."""
    return np.r_[n.sum(), n @ y, n @ x, n @ (x * x)]


def _slopes(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, design: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Number of candidates, the sum of their loss at w, its gradient and its Hessian."""
    x = design(x)
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return np.r_[n.sum(), n @ (np.logaddexp(0, z) - y * z), x.T @ (n * (p - y)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()]


def _standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x - mean) / scale


def _scored(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.c_[_standardised(x, mean, scale) @ weights, np.ones(len(x))]


def _logistic(sums: Sums, size: int, design: Callable[[np.ndarray], np.ndarray], ridge: float) -> np.ndarray:
    """Newton steps with a ridge until they are small; a step that makes the loss larger is halved."""
    at, step, least = np.zeros(size), np.zeros(size), np.inf
    while True:
        w = at - step
        s = sums(partial(_slopes, w=w, design=design))
        loss = s[1] / s[0] + ridge / 2 * w @ w
        if loss > least + 1e-12 and np.abs(step).max() > 1e-6:
            step = step / 2
            continue
        at, least = w, loss
        step = np.linalg.solve(s[2 + size :].reshape(size, size) / s[0] + ridge * np.eye(size), s[2 : 2 + size] / s[0] + ridge * w)
        if np.abs(step).max() < 1e-6:
            return at - step


def _fit(sums: Sums, markov: Markov) -> Model:
    """The model for all labelled candidates; without both labels a fixed rule-like model."""
    size = len(features(Candidate("assign", "x", "xxxx", 0, 4, False), "", markov))
    s = sums(_moments)
    if s is None or not 0 < s[1] < s[0]:
        weights = np.zeros(size)
        weights[[20, 22, 25, 26, 27, 28, 29, 31]] = [3, -6, 4, -6, 3, 6, -8, 6]
        weights[0] = -2.5
        return Model(list(weights), [0.0] * size, [1.0] * size, (1.0, 0.0), markov)
    mean, squares = s[2:].reshape(2, size) / s[0]
    scale = np.sqrt(np.maximum(0, squares - mean**2))
    scale[scale < 1e-6] = 1
    mean[0], scale[0] = 0, 1
    w = _logistic(sums, size, partial(_standardised, mean=mean, scale=scale), 1e-3)
    a, b = _logistic(sums, 2, partial(_scored, mean=mean, scale=scale, weights=w), 1e-4)
    return Model(w.tolist(), mean.tolist(), scale.tolist(), (float(a), float(b)), markov)


def _labelled(rows: list[tuple[Candidate, str, int]], markov: Markov) -> list[tuple[list[float], int, int]]:
    """(features, label, number) of the candidates that a pattern settles among (candidate, path, number)."""
    return [(features(c, path, markov), y, n) for c, path, n in rows if (y := weak_label(c)) is not None]


def train(reads: list[tuple[str, str]]) -> Model:
    """Fit on (path, content) pairs in this process."""
    pairs = Pairs()
    seen: Counter = Counter()
    for path, content in reads:
        for _, text in lines_of(content):
            found = candidates(text)
            pairs.add(text if not found else found[0].name)
            seen.update((c.place, c.name, c.value, c.comment, telling_path(path)) for c in found)
    markov = Markov(pairs.total())
    rows = _labelled([(Candidate(place, name, value, 0, 0, comment), path, n) for (place, name, value, comment, path), n in seen.items()], markov)
    chunk = [np.array(x) for x in zip(*rows)]
    return _fit(lambda f: f(*chunk) if chunk else None, markov)


def lines_of(content: str) -> list[tuple[int | None, str]]:
    """(line number or None for a notice, text) of each shown line."""
    result = []
    for raw in content.split("\n"):
        m = _LINE.match(raw)
        result.append((int(m.group(1)), m.group(2)) if m else (None, raw))
    return result


def key_blocks(lines: list[tuple[int | None, str]]) -> list[tuple[int, list[int]]]:
    """(index of the first line shown, indices of the lines with key material) of each private key block, also cut ones."""
    blocks, i = [], 0
    while i < len(lines):
        text = lines[i][1]
        if _BEGIN_KEY.search(text):
            j = i
            body = [i] if not text.rstrip("\r \",").endswith("KEY-----") else []
            while j + 1 < len(lines) and not _END_KEY.search(lines[j][1]):
                if not (_KEY_LINE.match(lines[j + 1][1]) or _END_KEY.search(lines[j + 1][1]) or lines[j + 1][0] is None):
                    break
                j += 1
                if not _END_KEY.search(lines[j][1]) and lines[j][0] is not None:
                    body.append(j)
            blocks.append((i, body))
            i = j + 1
        elif _END_KEY.search(text):  # the beginning is not shown
            j = i - 1
            while j >= 0 and lines[j][0] is not None and _KEY_LINE.match(lines[j][1]) and not _OTHER_PEM.search(lines[j][1]):
                j -= 1
            blocks.append((j + 1 if j + 1 < i else i, list(range(j + 1, i))))
            i += 1
        else:
            i += 1
    return blocks


def shown_in(content: str | None) -> Iterator[tuple[int | None, int, str, list[Candidate] | None]]:
    """(line number, index, text, candidates) of each line; the number is None where nothing can be found, candidates for the first line of a key block."""
    if not content:
        return
    lines = lines_of(content)
    blocks = key_blocks(lines) if "PRIVATE KEY" in content else []
    first, inside = {i for i, _ in blocks}, {k for _, body in blocks for k in body}
    for k, (number, text) in enumerate(lines):
        if k in first and number is not None:
            yield number, k, text, None
        yield None if k in first or k in inside or _OTHER_PEM.search(text) else number, k, text, candidates(text)


def _are_found(found: list[tuple[Candidate, str]], model: Model) -> list[bool]:
    return [p >= THRESHOLD and not _PLACEHOLDER.match(c.value) for (c, _), p in zip(found, model.scores(found))] if found else []


def found_in(content: str | None, path: str | None, model: Model) -> list[tuple[int, int, int, int]]:
    """(line number, index of the line, start, end) of each credential; a key block has one entry with its line and -1, -1."""
    result, judged = [], []
    for number, k, _, found in shown_in(content):
        if found is None:
            result.append((number, k, -1, -1))
        elif number is not None:
            judged += [(number, k, c) for c in found]
    return result + [(number, k, c.start, c.end) for (number, k, c), yes in zip(judged, _are_found([(c, path or "") for *_, c in judged], model)) if yes]


def redact(content: str | None, path: str | None, model: Model) -> str | None:
    """The content with each credential masked: quotes, names, line numbers and line ends stay."""
    if not content:
        return content
    found = found_in(content, path, model)
    if not found:
        return content
    raw, lines = content.split("\n"), lines_of(content)
    for first, body in key_blocks(lines):
        for k in body:
            raw[k] = re.sub(r"[A-Za-z0-9+/=]{4,}(?=(?:\\n)?[\",\s]*$)", MASK, raw[k]) if k != first else re.sub(r"(KEY-----)(?:(?!-----END).)+", rf"\1{MASK}", raw[k])
    for _, k, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= 0:
            shift = len(raw[k]) - len(lines[k][1])
            text = raw[k][shift + start : shift + end]
            masked = text[0] + MASK + text[0] if text[:1] in "\"'`" else MASK
            raw[k] = raw[k][: shift + start] + masked + raw[k][shift + end :]
    return "\n".join(raw)


_SHOWN = {"read_id": "bigint", "line_no": "bigint", "place": "string", "name": "string", "value": "string", "comment": "boolean", "path": "string", "pair": "int", "n": "bigint"}
_EQUAL = ("place", "name", "value", "comment", "path")
#: Rows that a worker gathers before it hands them on.
GATHERED = 20_000


def _show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate and, with the place key, each key block of the reads; at the end the counts of the pairs of characters."""
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[t] for t in _SHOWN.values()]
    pairs, rows = Pairs(), []

    def gathered() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=list(_SHOWN))

    for batch in batches:
        for read_id, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            path = telling_path(path)
            for number, _, text, found in shown_in(content):
                if number is not None and number >= 1 << 63:  # no line_no can tell it
                    number = None
                if found is None:
                    rows.append((read_id, number, "key", None, None, None, None, None, None))
                    continue
                pairs.add(text if not found else found[0].name)
                rows += [(read_id, number, c.place, c.name, c.value, c.comment, path, None, None) for c in found]
                if len(rows) >= GATHERED:
                    yield gathered()
                    rows.clear()
    total = pairs.total()
    rows += [(*[None] * 7, int(pair), int(total[pair])) for pair in np.flatnonzero(total)]
    if rows:
        yield gathered()


def _shown(reads: DataFrame) -> DataFrame:
    return spread(reads.where(F.col("content").isNotNull()).select("read_id", "rel_path", "content")).mapInArrow(_show, ", ".join(f"{name} {kind}" for name, kind in _SHOWN.items()))


def _read_back(batch: pa.RecordBatch) -> list[tuple[Candidate, str]]:
    return [(Candidate(place, name, value, 0, 0, comment), path) for place, name, value, comment, path in zip(*(batch.column(x).to_pylist() for x in _EQUAL))]


def _featured(batches: Iterator[pa.RecordBatch], markov: Markov) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _labelled([(c, path, n) for (c, path), n in zip(_read_back(batch), batch.column("n").to_pylist())], markov)
        x, *rest = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array([np.array(v).tobytes() for v in x], pa.binary()), *(pa.array(v, pa.int64()) for v in rest)], names=["x", "y", "n"])


def _added(batches: Iterator[pa.RecordBatch], f: Callable[..., np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(batch.num_rows, -1)
            part = f(x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _fitted(shown: DataFrame) -> Model:
    """Train on all candidates and pairs of a written table of _shown."""
    pairs = np.zeros(128 * 128, np.int64)
    for pair, n in shown.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n")).collect():
        pairs[pair] = n
    markov = Markov(pairs)
    equal = shown.where("pair IS NULL AND place <> 'key'").groupBy(*_EQUAL).agg(F.count(F.lit(1)).alias("n"))
    rows = cut(equal.mapInArrow(partial(_featured, markov=markov), "x binary, y bigint, n bigint"))

    def sums(f: Callable[..., np.ndarray]) -> np.ndarray | None:
        parts = [np.frombuffer(r["total"]) for r in rows.mapInArrow(partial(_added, f=f), "total binary").collect()]
        return np.sum(parts, axis=0) if parts else None

    return _fit(sums, markov)


def fitted_model(reads: DataFrame) -> Model:
    """Train on all candidates of all reads."""
    return _fitted(cut(_shown(reads)))


def _find(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = [place == "key" for place in batch.column("place").to_pylist()]
        judged = iter(_are_found([x for x, is_key in zip(_read_back(batch), key) if not is_key], model))
        yield batch.select(["read_id", "line_no"]).filter(pa.array([is_key or next(judged) for is_key in key], pa.bool_()))


def _redact(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redact(c, p, model) for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["read_id", "content"])


def credential_lines(reads: DataFrame, model: Model | None = None) -> DataFrame:
    """(read_id, line_no): each line of a read's content that shows a usable credential, once.

    A private key block counts at the first of its lines shown. Notices, which carry no number, are never found. Null and empty
    contents hold nothing, null paths are taken as ''. Repeated rows give one result.
    """
    shown = _shown(reads) if model else cut(_shown(reads))
    rows = shown.where("line_no IS NOT NULL").select("read_id", "line_no", *_EQUAL)
    return rows.mapInArrow(partial(_find, model=model or _fitted(shown)), "read_id bigint, line_no bigint").distinct()


def redacted_reads(reads: DataFrame, model: Model | None = None) -> DataFrame:
    """(read_id, content): every row with its credentials masked; null contents stay null."""
    model = model or fitted_model(reads)
    return spread(reads.select("read_id", "rel_path", "content")).mapInArrow(partial(_redact, model=model), "read_id bigint, content string")
