"""Credentials in source code, configuration, logs and prose: found, located and masked.

Candidates are quoted strings, long tokens, assigned values and values that a sentence, an option or a URL announces. Of each the alphabet is told (hexadecimal, base 32, one-case base 36,
base 64 or printable) and its Shannon entropy is compared with a threshold that depends on alphabet and length: what a random string of that length over that alphabet almost surely
reaches. A candidate counts when it reaches

* the whole threshold, wherever it stands, unless its shape or what stands before it says hash, revision, identifier, image data or public key; or
* ``NAMED`` times the threshold where what stands before it names a credential, for passwords that people choose are less random than keys; or
* ``NAMED`` times the threshold with the fixed prefix of a known kind of token, or within the block of a private key.

Placeholders, masked values, references to environment, file or vault, calls, types and plain words are excluded everywhere.

Defined cases: null ids are ignored, null and empty texts hold nothing, a repeated id counts once, extra columns are ignored. Lines end at LF
and count from 1; positions are code points from 0. A value in parts (adjacent literals, a sum of literals, a YAML block) begins with its first part. A private key reaches from its BEGIN line to its
END line or, where that is missing, to the last line that looks like a part of it. Values of any length count; nothing is cut.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import ship, spread

#: Parts of key names that mean a credential, compared without case, accents and separators.
NAMES = (
    "password", "passwd", "passphrase", "passwort", "kennwort", "contrasena", "motdepasse", "secret", "token", "apikey", "accesskey", "privatekey", "encryptionkey",
    "signingkey", "jaaskey", "authkey", "sharedkey", "masterkey", "credential", "creds", "authorization", "clave", "webhook",
)
#: Endings of key names that mean a credential.
ENDINGS = ("pass", "pwd", "pw", "auth", "sig")
#: Endings of key names that mean something about a credential, not the credential.
ABOUT = (
    "file", "path", "length", "len", "days", "ttl", "hours", "seconds", "name", "id", "url", "uri", "count", "min", "max", "header", "type", "env", "field", "budget", "policy", "expiry", "expires",
    "limit", "hash", "prefix", "enabled", "required", "hint", "reset", "tokenizer", "tokens", "location", "version", "algorithm",
)
#: Values that stand for a value that is not there.
PLACEHOLDERS = frozenset(
    "changeme change-me change_me todo fixme tbd null none nil undefined true false empty example dummy placeholder redacted secret password passwd token string str int bool bytes text value hidden masked test foo bar na n/a unset default required optional".split()
)
_HOLLOW = re.compile(
    r"^(?:<[^>]*>?|\$.*|%[A-Z_]+%|\{.*|\[.*|#\{.*|@@?\w+@@|.*\[REDACTED.*|.*(?:\*{3,}|[xX]{5,}|\.{3,}|•{3,}|…).*|[*xX#._-]+|your[-_ ]?.*|my[-_]?(?:secret|password|token|key).*"
    r"|(?:os|process|self|this|config|settings|env|args|opts|cfg|system|vault|secrets?|ref|file|arn|keyring|ssm|op)[.:(\[/].*|[A-Za-z_][\w.]*[(\[].*|~?\.{0,2}(?:/[a-z0-9_.\-]+){2,}/?|!vault.*|\d{1,5})$",
    re.I,
)
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[\w-]{20,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[\w-]{20,}|AIza[\w-]{30,}|A[KS]IA[A-Z0-9]{16}(?![A-Z0-9])"
    r"|[A-Za-z0-9]+_pat_[A-Za-z0-9]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|AGE-SECRET-KEY-1[A-Z0-9]{40,})"
)
_TOKEN_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "_pat_", "glpat-", "xox", "k_live_", "k_test_", "sk-", "AIza", "AKIA", "ASIA", "eyJ", "SG.", "npm_", "hf_", "AGE-")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Between BEGIN and END: white space (also escaped or between quoted lines), headers, and runs of base 64.
_KEY_PART = re.compile(r"""(?:\s|\\r|\\n|["'`+,>|#]|//)*(?:[A-Za-z][A-Za-z0-9-]{1,30}: [^\n\\]*|=?[A-Za-z0-9+/]{4,}={0,2})""")
_OPEN_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST|PGP SIGNATURE|PGP MESSAGE)[^-]*-----.*?(?:-----END[^-]*-----|\Z)", re.S)
_ASSIGN = re.compile(r"""([A-Za-z_À-ÿ][\w.\-À-ÿ]{1,90})["'`]?\]?\s{0,3}(?::\s{0,2}[A-Za-z_][\w\[\], |]{0,30}\s=(?!=)|=>|:=|[:=](?!=)|,(?=\s{0,3}["'`]))[ \t]{0,3}""")
_PHRASE = re.compile(
    r"(?i)\b(?:pass ?words?|passwd|passphrase|pwd|passwort|kennwort|contrase[nñ]a|clave|mot de passe|api[ -]?key|secret|token|access key|zugangscode|credentials?)\b(?:\s+(?:for|für|fuer|pour|para|of|de|del|von)\s+\S{1,60})?"
    r"\s*(?:\bis\b|\bwas\b|\blautet\b|\bist\b|\best\b|\bes\b|\bnow\b|=|:)\s*:?\s*(?=\S)"
)
_LOGIN = re.compile(r"(?i)\b(?:login|pw|pwd|passw(?:or)?d|creds?|credentials?|zugang|zugangsdaten|acceso|identifiants?|access|account)\s{0,2}:\s{0,2}\S{1,60}\s{0,2}/\s{0,2}(?=\S)")
_NETRC = re.compile(r"(?i)\b(?:login|user)\s+\S{1,60}\s+pass(?:word|wd)?\s+(?=\S)")
_OPTION = re.compile(r"(?i)(?<![\w-])--?(?:[\w-]*(?:token|secret|password|passwd|api-?key|access-?key|passphrase|credential)|pass|pwd|auth)(?:=|\s{1,3})(?=\S)")
_SHORT = re.compile(r"(?:\bsshpass\s+-p\s*|\b(?:mysql|mysqldump|mariadb|mysqladmin)\b[^\n|;]{0,120}?\s-p)(?=\S)")
_USERPWD = re.compile(r"""\bcurl\b[^\n]{0,200}?\s(?:-u|--user)\s{0,2}["']?[\w.@-]{1,60}:(?=\S)""")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://(?:[^\s:/@\"'`<>]*):([^\s/\"'`<>]+)@(?=[\w\[])")
_URL_TOKEN = re.compile(r"\bhttps?://([A-Za-z0-9_\-]{16,})@(?=\w)")
_QUERY = re.compile(r"(?i)[?&](?:api[_-]?key|access[_-]?key|key|sig|signature|token|access_token|auth|secret|password|pwd|code)=(?=[^\s&])")
_SUM = re.compile(r"""(["'`])([^"'`\n]{3,})\1\s*(?:\+|\.\.?|\|\|)\s*(["'`])([^"'`\n]{3,})\3""")
_LONG = re.compile(r"[A-Za-z0-9+/_\-]{20,}={0,2}")
_QUOTED = re.compile(r"""(["'`])([^"'`\s\\<>{}()\[\]|]{16,})\1""")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token|digest|apikey|negotiate)\s{1,2}(?=\S)")
_LITERAL = re.compile(r"""([fFbBrRuU]{0,2})("{3}|'{3}|["'`])""")
_PART = re.compile(r"""\s*\(?\s*[bBrRuU]{0,2}(["'`])([^"'`\n]+)\1""")
#: What says before a value that it is no secret; no alternative is longer than ``_BEFORE`` characters.
_NEGATIVE = re.compile(r"(?i)(?:sha-?\d{0,4}[-:\s]|md5|digest|checksum|integrity|revision|commit|checkout|hash|etag|uuid|guid|fingerprint|\brun|\bid|_id|tree|blob|parent|base64,|public|ssh-(?:rsa|ed25519|dss)|nonce|build|image|cursor|signature|trace|span|request)\W{0,6}$")
_BEFORE = 24
_DATA = re.compile(r"[\w/+.\-;,:]*")
#: The share of the threshold that suffices where a name announces a credential.
NAMED = 0.6
_HEX, _BASE_32, _ONE_CASE, _BASE_64 = (re.compile(p) for p in ("[0-9a-f]+|[0-9A-F]+", "[A-Z2-7]+", "[a-z0-9]+|[A-Z0-9]+", "[A-Za-z0-9+/_-]+"))
#: Words of an explanation; a phrase with one of them is no passphrase.
EXPLAINING = frozenset("a an the is are be been must should your my our their enter please at least of to for in on with and or not no this that it if when from here field user value characters".split())
#: Anything that a rule other than a known prefix or a long token can start from; tested on the lower-cased text.
_HINTS = ("pass", "pw", "secret", "token", "key", "cred", "kennwort", "contrase", "clave", "auth", "login", "webhook", "zugang", "acceso", "identifiant", "account", "sig", " -p", "://", "curl", "code=", "geheim", "access")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


@lru_cache(maxsize=1 << 16)
def _expected(n: int, alphabet: int) -> float:
    """The mean entropy of ``n`` characters drawn from an alphabet of so many: log2(n) less the mean of c log2(c) over the characters' binomial counts c."""
    share, log_n = 1 / alphabet, math.lgamma(n + 1)
    total = 0.0
    for c in range(2, min(n, int(n * share + 12 * math.sqrt(n * share) + 12)) + 1):
        chance = math.exp(log_n - math.lgamma(c + 1) - math.lgamma(n - c + 1) + c * math.log(share) + (n - c) * math.log(1 - share))
        total += c * math.log2(c) * chance
    return math.log2(n) - alphabet * total / n


def threshold(n: int, alphabet: int) -> float:
    """The least entropy that a random string of ``n`` characters of an alphabet of so many reaches almost surely: the mean less 0.4, two standard deviations and more from 20 characters on."""
    return max(2.0, (_expected(n, alphabet) if n <= 4096 else math.log2(alphabet) - (alphabet - 1) / (2 * n * math.log(2))) - 0.4)


def alphabet(value: str) -> int:
    """The size of the smallest alphabet that a value is written in: hexadecimal, base 32, letters of one case and digits, base 64, printable."""
    core = value.rstrip("=")
    for pattern, size in ((_HEX, 16), (_BASE_32, 32), (_ONE_CASE, 36), (_BASE_64, 64)):
        if pattern.fullmatch(core):
            return size
    return 94


def reaches(value: str, share: float = 1.0) -> bool:
    """Is its entropy at or above a share of its alphabet's threshold for its length?"""
    core = value.rstrip("=") or value
    return entropy(core) >= share * threshold(len(core), alphabet(core))


def looks_random(value: str, share: float = 1.0) -> bool:
    """Is it above the threshold of its alphabet, and as mixed as a random string of it: in kinds of characters and in how often they change?"""
    core = value.rstrip("=")
    digit, upper, lower = any(c.isdigit() for c in core), any(c.isupper() for c in core), any(c.islower() for c in core)
    size = alphabet(core)
    mixed = digit and (upper or lower) if size <= 36 else digit and upper and lower
    if len(core) < 16 or not mixed or size == 94 and all(c.isalnum() for c in core):
        return False
    changes = sum((a.isdigit(), a.isupper(), a.isalnum()) != (b.isdigit(), b.isupper(), b.isalnum()) for a, b in zip(core, core[1:]))
    return changes >= len(core) / 5 and reaches(core, share)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower().replace("ñ", "n"))


def names_credential(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z0-9ñ]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if w]
    if not words or words[-1] in ABOUT or (len(words) > 1 and words[-2] in ("ttl", "min", "max")):
        return False
    flat = _plain(name).replace("tokenizer", "")
    return any(k in flat for k in NAMES) or words[-1] in ENDINGS or flat.endswith("pwd")


def usable(value: str, quoted: bool) -> bool:
    """Is it a literal value that could be used as it stands, and random enough for one that is announced?"""
    return _literal(value, quoted) and reaches(value, NAMED)


def passphrase(value: str) -> bool:
    """Is it a phrase of words that explains nothing?"""
    words = value.split(" ")
    return 4 <= len(words) and all(w.isalpha() and w.islower() and 3 <= len(w) <= 12 for w in words) and len(set(words)) == len(words) and not EXPLAINING & set(words) and reaches(value, NAMED)


def _literal(value: str, quoted: bool) -> bool:
    if len(value) < 5 or " " in value.strip() or value.lower().strip("<>[]{}()") in PLACEHOLDERS or _HOLLOW.match(value):
        return False
    if "://" in value:
        return False
    digit, upper, lower = any(c.isdigit() for c in value), any(c.isupper() for c in value), any(c.islower() for c in value)
    if digit and (upper or lower):
        return not re.fullmatch(r"v?\d+(?:\.\d+)*\w?|\d+(?:ms|s|m|h|d|mb|kb|gb|px|%)", value, re.I)
    if len([w for w in value.split("-") if len(w) >= 3]) >= 3 and re.fullmatch(r"[A-Za-z]+(?:-[A-Za-z]+)+", value):
        return True
    if digit:
        return len(value) >= 6 and not re.fullmatch(r"[\d.:/\-]+", value) or value.isdigit() and len(value) >= 6
    if upper and lower:
        inner = value[1:]
        special = any(not c.isalnum() and c not in "_.-/'" for c in value)
        return special and len(value) >= 8 and quoted or len(value) >= 8 and value.isalpha() and sum(a.isupper() != b.isupper() for a, b in zip(inner, inner[1:])) >= 2 and entropy(value) >= threshold(len(value), 52) - 0.3 and not _camel(value)
    return False


def _camel(value: str) -> bool:
    """Is it made of words in camel case?"""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)
    return all(len(p) >= 3 for p in parts)


class Found:
    __slots__ = ("start", "end", "kind")

    def __init__(self, start: int, end: int, kind: str):
        self.start, self.end, self.kind = start, end, kind


def _value_at(text: str, at: int) -> list[tuple[int, int, str, bool]]:
    """The value that begins at a position: (start, end, whole value, quoted); of a value in parts, the span of the parts' first to last character."""
    n = len(text)
    if at >= n:
        return []
    if text[at] == "(" or text[at] in "|>\\" and re.match(r"[|>][+-]?\d?[ \t]*\r?\n|\\\r?\n", text[at : at + 8]):
        if text[at] == "(":
            found, pos, out, first = _PART.match(text, at), at, "", None
            while found:
                first = found.start(2) if first is None else first
                out, last, pos = out + found.group(2), found.end(2), found.end()
                found = _PART.match(text, pos)
            return [(first, last, out, True)] if first is not None else []
        line = re.compile(r"[^\n]*\n[ \t]*([^\s#][^\n]*)").match(text, at)
        if not line:
            return []
        value = line.group(1).rstrip("\r \t'\"\\`,;")
        start = line.start(1)
        if value[:1] in "'\"":
            start, value = start + 1, value[1:]
        return [(start, start + len(value), value, False)] if value else []
    opening = _LITERAL.match(text, at)
    if opening:
        mark, start = opening.group(2), opening.end()
        if len(mark) == 3:
            end = text.find(mark, start)
            end = n if end < 0 else end
            body = text[start:end]
            inner = start + len(body) - len(body.lstrip())
            return [(inner, inner + len(body.strip()), body.strip(), True)]
        end = start
        while end < n and text[end] != "\n" and text[end] != mark:
            end += 2 if text[end] == "\\" else 1
        end = min(end, n)
        value = text[start:end]
        more, out, last = re.compile(r"\s*\+?\s*").match(text, end + 1), value, end
        while more is not None:
            part = re.compile(r"""[bBrRuU]{0,2}(["'`])([^"'`\n]+)\1""").match(text, more.end())
            if not part or "+" not in more.group(0):
                break
            out, last = out + part.group(2), part.end(2)
            more = re.compile(r"\s*\+?\s*").match(text, part.end())
        return [(start, last, out, True)]
    bare = re.compile(r"[^\s\"'`]+").match(text, at)
    if not bare:
        return []
    value = bare.group(0).rstrip(",;)]}>.:" if not bare.group(0).startswith(("<", "[", "{", "$", "(")) else ",;")
    return [(at, at + len(value), value, False)] if value else []


def _scheme(text: str, span: tuple[int, int, str, bool]) -> tuple[int, int, str, bool]:
    """Without a leading ``Bearer`` and the like; of an unquoted one, the word after it."""
    start, end, value, quoted = span
    found = _SCHEME.match(text, start)
    if not found:
        return span
    if quoted:
        return (found.end(), end, value[found.end() - start :], quoted)
    rest = _value_at(text, found.end())
    return rest[0] if rest else span


def _decoded_pair(value: str) -> bool:
    """Does it hold ``user:password`` in base 64?"""
    try:
        plain = base64.b64decode(value, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return plain.isprintable() and ":" in plain


def _key_end(text: str, at: int) -> int | None:
    """Where the private key ends whose BEGIN mark ends at a position; None if nothing random follows, as in an example."""
    mark = _PRIVATE_END.search(text, at)
    begin = _PRIVATE.search(text, at)
    if mark and begin and begin.start() < mark.start():
        mark = None  # the END of a later key
    pos, body = at, []
    while True:
        part = _KEY_PART.match(text, pos, mark.start() if mark else len(text))
        if not part:
            break
        run = re.search(r"[A-Za-z0-9+/=]+$", part.group(0)).group(0) if ": " not in part.group(0) else ""
        if not mark and body and run and len(run) < 16 and not run.endswith("=") and " " in text[part.end() : part.end() + 1]:
            break  # prose again
        body.append(run)
        pos = part.end()
    whole = "".join(body)
    if len(whole) < 16 or not reaches(whole[:4096], NAMED):
        return None
    return mark.end() if mark else pos


def _excluded(text: str, value: str, start: int) -> bool:
    """Does its shape or what stands before it say hash, identifier, image data or placeholder?"""
    if alphabet(value) == 16 or _HOLLOW.match(value) or "://" in value:
        return True
    if _NEGATIVE.search(text[max(0, start - _BEFORE) : start]):
        return True
    data = text.rfind("data:", 0, start)
    return data >= 0 and _DATA.match(text, data, start).end() == start


def find(text: str | None) -> list[Found]:
    """The credentials of a text, ascending, none within another."""
    if not text:
        return []
    out: list[Found] = []
    closed: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in _PRIVATE.finditer(text):
            end = _key_end(text, m.end())
            if end:
                out.append(Found(m.start(), end, "private-key"))
        closed = [m.span() for m in _OPEN_BLOCK.finditer(text)]
    if any(h in text for h in _TOKEN_HINTS):
        for m in _TOKEN.finditer(text):
            if not _HOLLOW.match(m.group(0)) and reaches(m.group(0), NAMED):
                out.append(Found(m.start(), m.end(), "token"))
    low = text.lower()
    if any(h in low for h in _HINTS):

        def take(at: int, kind: str, strict: bool = False, name: str = "") -> None:
            for span in _value_at(text, at):
                start, end, value, quoted = _scheme(text, span)
                if usable(value, quoted and not strict) or quoted and _plain(name).endswith(("password", "passphrase", "passwd", "pwd")) and passphrase(value):
                    out.append(Found(start, end, kind))

        for m in _ASSIGN.finditer(text):
            name = m.group(1)
            if names_credential(name):
                if not (name.lower().endswith(("auth", "sig")) and not any(k in _plain(name) for k in NAMES)):
                    take(m.end(), "secret", name=name)
                else:
                    for span in _value_at(text, m.end()):
                        start, end, value, quoted = _scheme(text, span)
                        if usable(value, quoted) and (quoted or looks_random(value)) and (len(value) >= 8 or _decoded_pair(value)):
                            out.append(Found(start, end, "secret"))
            elif name.lower().endswith("key"):
                for span in _value_at(text, m.end()):
                    if looks_random(span[2]):
                        out.append(Found(span[0], span[1], "secret"))
        for rule, kind in ((_PHRASE, "password"), (_LOGIN, "password"), (_NETRC, "password"), (_OPTION, "secret"), (_SHORT, "password"), (_USERPWD, "password")):
            for m in rule.finditer(text):
                take(m.end(), kind, strict=True)
        if "://" in text:
            for m in _URL.finditer(text):
                if usable(m.group(1), True) or len(m.group(1)) >= 4 and any(c.isdigit() for c in m.group(1)) and not _HOLLOW.match(m.group(1)):
                    out.append(Found(m.start(1), m.end(1), "password"))
            for m in _URL_TOKEN.finditer(text):
                if usable(m.group(1), True):
                    out.append(Found(m.start(1), m.end(1), "token"))
            for m in _QUERY.finditer(text):
                value = re.compile(r"[^\s&\"'`<>)]+").match(text, m.end())
                if value and usable(value.group(0), True) and len(value.group(0)) >= 12:
                    out.append(Found(value.start(), value.end(), "token"))
    quotes = "'" in text or '"' in text or "`" in text
    if quotes:
        for m in _SUM.finditer(text):
            whole = m.group(2) + m.group(4)
            if _TOKEN.fullmatch(whole) or looks_random(whole):
                out.append(Found(m.start(2), m.end(4), "token"))
    seen = set()
    for pattern, group in ((_LONG, 0), (_QUOTED, 2)) if quotes else ((_LONG, 0),):
        for m in pattern.finditer(text):
            value, start = m.group(group), m.start(group)
            if start in seen or "/" in value and not looks_random(value.replace("/", "")):
                continue
            if looks_random(value) and not _excluded(text, value, start) and not any(a <= start < b for a, b in closed):
                seen.add(start)
                out.append(Found(start, m.end(group), "token"))
    out.sort(key=lambda f: (f.start, -f.end))
    kept: list[Found] = []
    for f in out:
        if any(a <= f.start < b for a, b in closed):
            continue
        if kept and f.start < kept[-1].end:
            kept[-1].end = max(kept[-1].end, f.end)
            continue
        kept.append(f)
    return kept


def mask(text: str, found: list[Found]) -> str:
    """The text with each value, and nothing else, replaced by ``[REDACTED:kind]``."""
    parts, at = [], 0
    for f in found:
        parts += [text[at : f.start], f"[REDACTED:{f.kind}]"]
        at = f.end
    return "".join([*parts, text[at:]])


def _udf(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, starts, ends, kinds, texts = [], [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find(text)
                if not found:
                    continue
                whole = mask(text, found) if masked else None
                for f in found:
                    ids.append(name)
                    lines.append(text.count("\n", 0, f.start) + 1)
                    starts.append(f.start)
                    ends.append(f.end)
                    kinds.append(f.kind)
                    texts.append(whole)
            columns = [pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())]
            names = ["id", "line_no", "start", "end", "kind"]
            if masked:
                columns.append(pa.array(texts, pa.string()))
                names.append("masked")
            yield pa.record_batch(columns, names=names)

    return run


def credentials(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``line_no``, ``start``, ``end``, ``kind``): one row per credential."""
    ship(df.sparkSession)
    source = spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).where("id is not null and text is not null")
    return source.mapInArrow(_udf(False), "id bigint, line_no bigint, start bigint, end bigint, kind string").distinct()


def masked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``n_masked``, ``text``): the texts that hold credentials, with the values masked."""
    ship(df.sparkSession)
    source = spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).where("id is not null and text is not null")
    found = source.mapInArrow(_udf(True), "id bigint, line_no bigint, start bigint, end bigint, kind string, masked string")
    return found.select("id", "start", "masked").distinct().groupBy("id").agg(F.count("*").alias("n_masked"), F.first("masked").alias("text"))
