"""Credentials embedded in source code: places and redacted texts (problem 3).

A text is scanned for credential values by their own form (vendor prefixes, signed hook addresses, web tokens, private
key blocks, addresses and headers that hold a password) and by what names them (an identifier, key, flag or comment that
says password, token, key, ...). A named value counts only if it looks drawn at random or chosen as a password:
placeholders, references to the environment or a vault, digests, ids and plain words are none.

Literals are then decoded, layer by layer: escapes, percent, hex and base64. What a layer yields is scanned the same
way, bytes are read as key containers by their binary grammar (DER private keys to their last field, OpenSSH ones by their
length prefixes), and objects in JSON by their fields. A find in any layer marks the whole encoded run of the outermost
text. Layers are followed until nothing decodes; each is shorter than the one before. Values have no greatest length.

Literals that are joined (side by side, by `+` or over lines) are one value, scanned and decoded as a whole: it begins at
the first piece, and the others are finds of the kind `part`, which have no line of their own. Values in a list, in a
string of several lines or in a block below a key are found as well.

Redaction puts MARK in place of each value, wherever else in the text it stands, and leaves every other character, so code
keeps its quotes, escapes and line breaks (a redacted private key keeps its lines). Null and empty texts have no places and
stay as they are.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "REDACTED"
CACHE_CHARS = 16_000_000

# What names a credential: words of an identifier, fixed values in several languages.
_NAMES = {
    "password", "passwords", "passwd", "passwort", "kennwort", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "token", "apikey",
    "credential", "credentials", "contrasena", "contraseña", "clave", "mdp", "motdepasse", "senha", "пароль", "wachtwoord", "psw",
}
_PAIRS = {
    (a, b)
    for a in ("api", "access", "private", "service", "signing", "secret", "auth", "master", "encryption", "account", "hmac", "shared", "client", "deploy", "app")
    for b in ("key", "token", "secret")
}
_AUTH = {"auth", "login", "creds", "cred", "credentials", "basic", "account"}
_WORDS = {"passphrase", "password", "passwords", "passwd", "pwd"}  # what may be several words or letters alone
_NOT_NAMES = {"public", "pub", "checksum", "digest", "integrity", "etag", "commit", "uuid", "fingerprint", "pixel", "trace"}
_SAID = re.compile(
    r"(?i)pass ?words?\b|\bpw\b|pass(?:wort|wd|phrase|code)\b|kennwort|contrase[nñ]a|mot de passe|\bsenha\b|пароль|密码|密碼|パスワード|비밀번호|كلمة المرور|पासवर्ड|รหัสผ่าน"
    r"|(?:signing|hmac|api|secret|private|encryption|access|shared|session|master|aes|symmetric) ?(?:key|secret|token)s?\b|\bcredentials?\b"
)
# What a line holds, in lower case, if a find can begin in it; other lines need no closer look. Each pattern below is
# implied: the names, pairs and _AUTH, what _SAID says, the forms, addresses, schemes of headers and flags.
_SAYS = ("pass", "kennwort", "contrase", "senha", "парол", "密码", "密碼", "パスワ", "비밀번", "المرور", "पासवर्ड", "รหัส", "credential")
_HINTS = tuple(
    {*_SAYS, *_AUTH, *(b for _, b in _PAIRS), *(n for n in _NAMES if not any(s in n for s in _SAYS))}
    | {"bearer", "basic", "digest", "akia", "asia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat", "glpat", "xox", "npm_", "pypi-", "sk_live", "rk_live", "aiza", "eyj", "hook", "://", "--user", "--proxy-user"}
)
# Flags of one letter, and names in two words (p_wd).
_FLAGGED = re.compile(r"-(?:u[ =]|[pw][\s='\"])")
_PARTED = re.compile("|".join("[-_.]*".join(n) for n in sorted(_NAMES) if not any(m != n and m in n for m in _NAMES)))
_SAME = str.maketrans("ſıİ", "sii")  # equal letters where case is ignored
_BELOW = re.compile(r"(?:\n[^\w\n]*+(?=\n))*+(?:\n[^\n]*+)?")  # lines without a word, and one more
_PLACE = re.compile(
    r"(?ix)^(?: x{4,} | \*{3,} | \.{3,} | -{3,} | (?:change|replace|insert|fill|put|add|set|enter|use|type)[-_ ]?(?:me|this|your|it|here|in|the|a)?.* | your[-_ ].* | my[-_ ]?(?:pass|secret|token).*"
    r"| <.*> | [^$\n]*+(?:\$(?!\{)[^$\n]*+)*+\$\{.*\}.* | \$\(.*\) | \$\w+ | \{\{.*\}\} | \{\w*\} | %\(?\w+\)?s? | example.* | dummy.* | sample.* | placeholder.* | todo.* | none | null | nil | undefined | redacted.* | test(?:ing)?\d* | secret | password\d{0,3}"
    r"| passw?d? | token | admin | root | user | guest | foo\w* | bar | baz | env[:.].* | (?:vault|kms|ssm|secrets?|arn|op|keyring|sops|gcp|aws)[:/].* | projects/.* | (?:os|process)\.env.* | .*getenv.* | sha(?:1|224|256|384|512)-.* | \{(?:ssha|sha|crypt)\}.* )$"
)
_PROSE = re.compile(r"(?i)\b(?:the|a|an|your|this|that|is|are|was|must|should|can|cannot|not|please|for|to|of|in|with|and|or|passphrase|password)\b")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_PUBLIC = re.compile(r"^(?:ssh-(?:rsa|ed25519|dss)|ecdsa-)\b|BEGIN (?:PUBLIC|CERTIFICATE)")

_FORMS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<aws>A(?:KI|SI)A[0-9A-Z]{16})(?![0-9A-Za-z])|(?P<gh>gh[opusr]_[A-Za-z0-9]{30,}|github_pat_\w{20,})|(?P<gl>glpat-[\w-]{18,})|(?P<slack>xox[abeoprs]-[A-Za-z0-9-]{12,})"
    r"|(?P<npm>npm_[A-Za-z0-9]{30,})|(?P<stripe>[sr]k_live_[A-Za-z0-9]{16,})|(?P<goog>AIza[\w-]{30,})|(?P<pypi>pypi-[\w-]{30,})"
    r"|(?P<jwt>eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{16,})"
    r"|https?://(?:[\w.-]*\.)?(?:hooks?|webhooks?)\.[\w.-]+/(?P<hook>(?:services|workflows|hooks?|api/webhooks)/[\w/-]{16,})"
    r")"
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:(?:\\[nr]|[\s\"'`+,;()])*[A-Za-z0-9+/=]{16,})*")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s:/@'\"`<>{}]*:(?P<v>[^\s@/'\"`]{3,})@")
_HEADER = re.compile(r"(?i)\b(?P<scheme>bearer|basic|token|apikey|digest)[ \t]+(?P<v>[A-Za-z0-9+/=._~-]{12,})")
_USER = re.compile(r"(?:^|\s)(?:-u|--user|--proxy-user)[ =]['\"]?[^\s:'\"]+:(?P<v>[^\s'\"\\]{4,})")
_FLAG = re.compile(
    r"(?:^|[\s'\"`\[(,{])(?:--?(?:password|passwd|pass|pwd|token|secret|api-?key|auth-?token|access-?token|passphrase|key)|-p|-P|-w)(?:\s+|=|['\"]\s*,\s*['\"])['\"]?(?P<v>[^\s'\"`,\\)\]]{6,})"
)
_IDENT = r"(?P<n>[^\W\d]\w*+(?:[-.][A-Za-z]\w*+)*+)"
_ASSIGN = re.compile(
    r"(?:(?<![\w\\.-])|(?<=\\[nrt]))" + _IDENT + r"""(?:\[[^\]\n]*\])?\\?["']?\s{0,3}(?::\s*[\w.\[\], |<>*&]{1,30}?\s*=(?!=)|:=|===?|!==?|=>|=|:|,)\s{0,3}\\?(?P<pre>[({\[]{0,2}\s{0,3}(?:[rbfuLR]|u8)?)(?P<q>"{3}|'{3}|"|'|`)(?P<v>[^"'`\n]+)"""
)
_DEFINE = re.compile(r"#[ \t]*define[ \t]+(?P<n>\w+)[ \t]+\(?[ \t]*[LuU]?\"(?P<v>[^\"\n]+)\"")
_BARE = re.compile(r"(?:(?<![\w.\\])|(?<=\\[nrt]))(?P<n>[A-Za-z][\w.-]*+)\s{0,2}[=:]\s{0,2}(?=(?:[^\s'\"`;&,()<>{}\[\]\\]|\\(?![nrt])){6})")
_WORD = re.compile(r"(?:[^\s'\"`;&,()<>{}\[\]\\]|\\(?![nrt]))++")
# The next literal joined to one that ends, or in a list behind it; the seam of two; values in blocks.
_JOIN = re.compile(r"[\"'`](?:[ \t]*\\?\r?\n?[ \t]*|\s*\+\s*(?:\\\r?\n\s*)?)[rbfuLR]{0,2}[\"'`](?P<v>[^\"'`\n]+)(?=[\"'`])")
_NEXT = re.compile(r"[\"'`]\s*,\s*[rbfuLR]{0,2}[\"'`](?P<v>[^\"'`\n]+)(?=[\"'`])")
_SEAM = re.compile(r"[\"'`](?<=[A-Za-z0-9+/=_%-].)(?=(?:[ \t]*\\?\r?\n?[ \t]*|\s*\+\s*(?:\\\r?\n\s*)?)[rbfuLR]{0,2}[\"'`][A-Za-z0-9+/=_%-])")
_BLOCK_VALUE = re.compile(
    r"[:=]\s{0,3}[rbfuLR]{0,2}(?P<q>\"{3}|'{3})\s*\n\s*(?P<v>[^\s\"'][^\"']*?)\s*(?P=q)"
    r"|:[ \t]+[|>][-+\d]*[ \t]*\r?\n(?P<i>[ \t]+)(?P<w>\S[^\n]*(?:\n(?P=i)\S[^\n]*)*)"
)
_NAME_BEFORE = re.compile(r"(?<![\w.-])([A-Za-z][\w.-]*)[\"']?\s{0,3}$")
_SECOND = re.compile(r"[\"'`]\s*,\s*[\"'`]([^\"'`\n]{6,})[\"'`]\s*[)\]}]")  # the second literal of a pair
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|/\*|--|<!--)\s*(.*)$|^\s*[*;]\s(.*)$")
_AFTER = re.compile(r"\s*(?:[:=]|is|ist|est|es|é|는|は|为|是)\s*['\"`]?(?P<v>[^\s'\"`,;]{6,})")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_ESCAPED = re.compile(r"(?:\\\\?x[0-9a-fA-F]{2}){8,}|(?:\\\\?u[0-9a-fA-F]{4}){6,}|(?:\\[0-7]{3}){8,}")
_PERCENT = re.compile(r"(?<![^\s%'\"])[^\s%'\"]*+(?:%[0-9A-Fa-f]{2}[^\s%'\"]*+){3,}")


def _words(name: str) -> list[str]:
    return [w.lower() for w in _SPLIT.findall(name)]


def names_credential(name: str) -> bool:
    """Whether a name holds a credential's word that no other word before or right behind it makes something else (public_key, token_digest)."""
    w = _words(name)
    at = [i for i, x in enumerate(w) if x in _NAMES] + [i + 1 for i, p in enumerate(zip(w, w[1:], strict=False)) if p in _PAIRS] + [1] * ("".join(w[:2]) in _NAMES)
    return bool(at) and not _NOT_NAMES & set(w[: min(at) + 2])


def looks_secret(v: str, low: int = 8) -> bool:
    """Whether a named value looks like a chosen or drawn credential rather than a word, a reference or a placeholder."""
    if len(v) < low or _PLACE.match(v) or _UUID.match(v) or _PUBLIC.match(v) or " " in v.strip():
        return False
    if len(set(v)) < 5:
        return False
    digits, letters = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    other = any(not c.isalnum() and c not in "-_./:" for c in v)
    if re.fullmatch(r"[a-z]+(?:[-_./:#][a-z]+)*", v) or re.fullmatch(r"[A-Z]+(?:[-_][A-Z]+)*", v) or re.fullmatch(r"[\w]+\([^)]*\)?;?", v):
        return False
    if re.fullmatch(r"https?://\S+|[\w./-]+\.(?:js|py|c|h|cpp|json|ya?ml|pem|txt|key|env|conf)", v):
        return False
    mixed = any(c.islower() for c in v) and any(c.isupper() for c in v)
    return letters and (digits or other or (mixed and not re.fullmatch(r"(?:[A-Z]?[a-z]++){1,6}|[a-z]+(?:[A-Z][a-z]+)+", v)) or (mixed and len(v) >= 16 and sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:], strict=False)) > len(v) * 0.45))


def _told(name: str, v: str) -> bool:
    """Whether the value of a credential's name is one: drawn at random, or by its name a phrase or a long word."""
    if looks_secret(v):
        return True
    own = _WORDS & set(_words(name))
    if not own or _PLACE.match(v):
        return False
    return bool(re.fullmatch(r"[a-z]{20,}", v)) or ("passphrase" in own and bool(re.fullmatch(r"[A-Za-z]{2,}(?:[ -][A-Za-z]{2,}){3,}", v)) and not _PROSE.search(v))


def _basic(v: str) -> bool:
    try:
        plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
    except (ValueError, UnicodeDecodeError):
        return False
    return ":" in plain and looks_secret(plain.split(":", 1)[1], 4)


# -- key containers ----------------------------------------------------------------------------------------------------


def _der(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element at a place."""
    if at + 2 > len(b):
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or at + k > len(b):
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    return tag, at, at + n


def _is_openssh(b: bytes) -> bool:
    """An OpenSSH private key: cipher, kdf, its options, the number of keys, public blocks and the private block, by their lengths."""
    at, magic = 15, b"openssh-key-v1\0"
    if not b.startswith(magic):
        return False

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(b):
            return None
        n = int.from_bytes(b[at : at + 4], "big")
        at += 4 + n
        return b[at - n : at]

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or not re.fullmatch(rb"[\w@.-]{2,64}", cipher) or not re.fullmatch(rb"[\w@.-]{2,64}", kdf) or at + 4 > len(b):
        return False
    many, at = int.from_bytes(b[at : at + 4], "big"), at + 4
    if not 0 < many < 64:
        return False
    for _ in range(many):
        block = string()
        if block is None or len(block) < 8:
            return len(b) > 60 and block is not None  # cut off
    return at >= len(b) or string() is not None


def is_key_container(b: bytes) -> bool:
    """DER private key (PKCS#1, SEC1, PKCS#8, encrypted PKCS#8) or an OpenSSH one, read field by field. A cut-off tail is tolerated."""
    if b[:4] == b"open":
        return _is_openssh(b)
    top = _der(b, 0)
    if not top or top[0] != 0x30 or top[2] < len(b) * 0.9 or top[2] > 4 * len(b) + 64 or len(b) < 24:
        return False
    fields, at = [], top[1]
    while at < min(top[2], len(b)) and (one := _der(b, at)):
        fields.append(one)
        at = one[2]
    if not fields or fields[0][2] > top[2]:
        return False
    tags = [t for t, _, _ in fields]
    whole = at == top[2] <= len(b)
    first = fields[0]
    if tags[0] == 0x02 and first[2] - first[1] == 1 and b[first[1]] in (0, 1) and len(tags) > 1:
        if tags[1] == 0x02:  # PKCS#1: integers to the end, or a modulus of 512 bits or more before fields that are damaged
            return (set(tags) == {0x02} and (len(tags) >= 9 or not whole)) or fields[1][2] - fields[1][1] >= 64
        if tags[1] == 0x04:  # SEC1: the private octets, then parameters and public key in context tags
            return b[first[1]] == 1 and fields[1][2] - fields[1][1] >= 16 and all(t & 0xA0 == 0xA0 for t in tags[2:])
        if tags[1] == 0x30:  # PKCS#8: algorithm with its oid, then octets
            oid = _der(b, fields[1][1])
            return bool(oid) and oid[0] == 0x06 and (tags[2:3] == [0x04] or (len(tags) == 2 and not whole))
        return False
    if tags[0] == 0x30:  # encrypted PKCS#8: algorithm with a PBES oid and its parameters, then octets
        oid = _der(b, first[1])
        if not oid or oid[0] != 0x06 or not b[oid[1] : oid[2]].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01"):
            return False
        inner = _der(b, oid[2])
        return bool(inner) and inner[0] == 0x30 and tags[1:] in ([0x04], [] if not whole else [0x04])
    return False


def is_key_object(text: str) -> bool:
    """Whether a text is an object in JSON with a credential in a field of any depth."""
    if text.lstrip()[:1] != "{":
        return False
    try:
        rest = [json.loads(text)]
    except (ValueError, RecursionError):
        return False
    while rest:
        x = rest.pop()
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            if isinstance(v, dict | list):
                rest.append(v)
            elif isinstance(v, str) and isinstance(k, str) and names_credential(k) and (_BLOCK.search(v) or _told(k, v)):
                return True
    return False


def layers(run: str) -> Iterator[bytes]:
    """What a run of characters may stand for."""
    if "\\x" in run or "\\u" in run or re.match(r"(?:\\[0-7]{3})", run):
        out = re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([0-7]{3})", lambda m: chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8) & 255), run)
        yield out.encode("latin-1", "replace")
        return
    if "%" in run:
        yield unquote(run, errors="replace").encode()
        return
    if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run):
        yield bytes.fromhex(run)
        return
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return


def _text(b: bytes) -> str | None:
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) >= 0.97 * len(s) else None


# -- scan ---------------------------------------------------------------------------------------------------------------


def _line(text: str, at: int) -> tuple[int, int]:
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    return a, len(text) if b < 0 else b


def _near(text: str) -> list[tuple[int, int]]:
    """Disjoint ranges of the lines with a hint, each with the line after it (lines without a word are passed over)."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lowered
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    if not low.isascii():
        low = low.translate(_SAME)
    starts: set[int] = set()
    for hint in _HINTS:
        at = low.find(hint)
        while at >= 0:
            starts.add(low.rfind("\n", 0, at) + 1)
            at = low.find("\n", at)
            at = low.find(hint, at) if at >= 0 else -1
    for pattern in (_FLAGGED, _PARTED):
        starts.update(low.rfind("\n", 0, m.start()) + 1 for m in pattern.finditer(low))
    out: list[tuple[int, int]] = []
    for a in sorted(starts):
        b = _BELOW.match(text, _line(text, a)[1]).end()
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(text: str) -> Iterator[re.Match]:
    yield from _RUN.finditer(text)
    if "\\" in text:
        yield from _ESCAPED.finditer(text)
    if text.count("%") > 2:
        yield from _PERCENT.finditer(text)


def _plain(text: str) -> Iterator[tuple[int, int, str]]:
    """Finds of a text as it stands."""
    if "PRIVATE KEY" in text:
        for m in _BLOCK.finditer(text):
            end = _BLOCK_END.search(text, m.end())
            nxt = _BLOCK.search(text, m.end())
            stop = end.end() if end and not (nxt and nxt.start() < end.start()) else _BODY.match(text, m.end()).end()  # its end may be cut off
            if len(re.findall(r"[A-Za-z0-9+/=]{16,}", text[m.end() : stop])):
                yield m.start(), stop, "private_key"
    for a, b in _near(text):
        yield from ((a + x, a + y, kind) for x, y, kind in _lines(text[a:b], text, a))
    for m in _BLOCK_VALUE.finditer(text):
        name = _NAME_BEFORE.search(text, text.rfind("\n", 0, m.start()) + 1, m.start())
        group = "v" if m["v"] else "w"
        lines = list(re.finditer(r"\S[^\n]*", m[group]))
        if name and names_credential(name[1]) and _told(name[1], "".join(x[0].strip() for x in lines)):
            at = m.start(group)
            yield at + lines[0].start(), at + lines[0].end(), "block"
            yield from ((at + x.start(), at + x.end(), "part") for x in lines[1:])


def _holds(run: str) -> bool:
    """Whether what a run of characters stands for, in whatever layer, holds a credential."""
    rest = list(layers(run))
    while rest:
        raw = rest.pop()
        if is_key_container(raw):
            return True
        inner = _text(raw)
        if inner and len(inner) >= 8:
            if next(_plain(inner), None) or is_key_object(inner):
                return True
            rest += [x for m in _runs(inner) if m[0] != run for x in layers(m[0])]
    return False


def _pieces(text: str, at: int) -> list[tuple[int, int]]:
    """Spans of the literals joined to the one whose value ends at a place."""
    out = []
    while m := _JOIN.match(text, at):
        at = m.end("v")
        out.append(m.span("v"))
    return out


def _joined(text: str) -> Iterator[tuple[int, int, str]]:
    """Values that stand in several joined literals and can be seen only when they are put together."""
    end = 0
    for m in _SEAM.finditer(text):
        if m.start() < end:
            continue
        quote = text[m.start()]
        a = text.rfind(quote, text.rfind("\n", 0, m.start()) + 1, m.start()) + 1
        if not a:
            continue
        spans = [(a, m.start()), *_pieces(text, m.start())]
        end = spans[-1][1]
        if len(spans) < 2:
            continue
        whole = "".join(text[x:y] for x, y in spans)
        seams = [sum(y - x for x, y in spans[:k]) for k in range(1, len(spans))]
        over = lambda x, y: any(x < s < y for s in seams)  # noqa: E731, B023
        if any(over(*f.span()) for f in _FORMS.finditer(whole)) or any(over(*r.span()) and _holds(r[0]) for r in _runs(whole)):
            yield *spans[0], "encoded"
            yield from ((x, y, "part") for x, y in spans[1:])


def _scan(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "encoded") for m in _runs(text) if _holds(m[0])] + list(_plain(text)) + list(_joined(text))


def _lines(text: str, full: str, base: int) -> Iterator[tuple[int, int, str]]:
    """Finds within a few lines, which begin at a place of the full text."""
    for m in _FORMS.finditer(text):
        yield *m.span(m.lastgroup), m.lastgroup
    for m in _ADDRESS.finditer(text):
        v = m["v"]
        if not re.fullmatch(r"(?i)\$\{?\w+\}?|<\w+>|\{+\w*\}+|%s|\$\w+|pass(?:word|wd)?|secret|pwd|x+|\*+|changeme|your\S*|redacted", v):
            yield *m.span("v"), "address"
    for m in _HEADER.finditer(text):
        v = m["v"]
        if m["scheme"].lower() == "basic":
            if _basic(v):
                yield *m.span("v"), "header"
        elif len(v) >= 16 and looks_secret(v) and any(c.isdigit() for c in v):
            yield *m.span("v"), "header"
    for m in _USER.finditer(text):
        if looks_secret(m["v"], 6):
            yield *m.span("v"), "user"
    for m in _FLAG.finditer(text):
        v = m["v"]
        if looks_secret(v, 6) and any(c.isalpha() for c in v) and any(c.isdigit() or not c.isalnum() for c in v):
            yield *m.span("v"), "flag"
    at = 0
    while m := _ASSIGN.search(text, at):  # the value of a name of something else is searched: another name may stand in it
        name, v, at = m["n"], m["v"], m.start("v")
        if names_credential(name):
            at = m.end()
            comma = text[m.end("n") : m.start("v")].strip("\\\"' ({[`")[:1] == ","
            if comma and not m["pre"].strip() and text[m.end("n") : m.end("n") + 1] not in ("'", '"'):
                continue
            v = v.rstrip("\\")
            more = [] if len(m["q"]) > 1 else _pieces(full, base + m.end("v"))
            if _told(name, v + "".join(full[x:y] for x, y in more)):
                yield m.start("v"), m.start("v") + len(v), "named"
                yield from ((x - base, y - base, "part") for x, y in more)
            if any(c in "([{" for c in m["pre"]):  # a list: every value
                end = base + m.end("v")
                while item := _NEXT.match(full, end):
                    end = item.end("v")
                    if _told(name, item["v"]):
                        yield item.start("v") - base, end - base, "named"
        elif m["pre"].strip() and _AUTH & set(_words(name)[:2]):
            close = _SECOND.match(text, m.end("v"))
            if close and looks_secret(close[1]):
                yield *close.span(1), "pair"
    for m in _DEFINE.finditer(text):
        if names_credential(m["n"]) and _told(m["n"], m["v"]):
            yield *m.span("v"), "named"
    at = 0
    while m := _BARE.search(text, at):
        at = m.end()
        if names_credential(m["n"].split(".")[-1]):
            v = _WORD.match(text, at)[0]
            at += len(v)
            v = v.split("\\n")[0].split("\\r")[0].rstrip("\\")
            before = text[max(0, m.start() - 1) : m.start()]
            odd = re.search(r"\w\(|^\w+\.\w+(?:\.|\[|$)|->|::|^&|\)$|\w+\[", v)
            if looks_secret(v) and not odd and before != "?" and any(c.isdigit() or c in "!@#$%^&*+/=~" for c in v):
                yield m.end(), m.end() + len(v), "bare"
    end, note, told = -1, None, False
    for m in _SAID.finditer(text):  # a comment that says what a literal near it is, or holds the value itself
        if m.start() >= end:  # a new line
            a, end = _line(text, m.start())
            line, told = text[a:end], False
            note = _COMMENT.search(line)
            alone = bool(note) and not line[: note.start()].strip()
        if not note or note.start() > m.start() - a:
            continue
        own = _AFTER.match(text, m.end(), end)
        if own and looks_secret(own["v"].rstrip(".)")):
            yield *own.span("v"), "comment"
            continue
        if told:
            continue
        told = True
        at, code = a, line[: note.start()]
        if alone:
            at, stop = _line(text, min(end + 1, len(text)))
            code = text[at:stop]
        for lit in _LITERAL.finditer(code):
            v = lit[lit.lastindex]
            if looks_secret(v) and (any(c.isdigit() for c in v) or re.search(r"[^\w\s.-]", v)):
                yield at + lit.start(lit.lastindex), at + lit.end(lit.lastindex), "said"


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) of the credential values of a text, in order."""
    if not text:
        return []
    got = sorted(_scan(text), key=lambda x: (x[0], x[2] != "part", -x[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in got:
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2])
            continue
        out.append((a, b, kind))
    return out


def redact(text: str | None) -> str | None:
    if not text:
        return text
    out, at, values = [], 0, set()
    for a, b, kind in find(text):
        out.append(text[at:a])
        body = text[a:b]
        if kind == "private_key":  # keep lines, quotes and escapes, so that the literal still closes
            body = re.sub(r"[A-Za-z0-9+/=]{12,}", MARK, body)
            body = re.sub(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", MARK, body)
            out.append(body)
        else:
            out.append(MARK)
            if len(body) >= 8 and kind != "part":
                values.add(body)
        at = b
    out.append(text[at:])
    whole = "".join(out)
    for v in sorted(values, key=lambda v: (-len(v), v)):  # the same value where nothing names it
        whole = whole.replace(v, MARK)
    return whole


def line_numbers(text: str | None) -> list[int]:
    spans = find(text)
    return sorted({text.count("\n", 0, a) + 1 for a, _, kind in spans if kind != "part"}) if spans else []


class _Once:
    """A function of texts whose answers are kept while the texts together are short."""

    def __init__(self, f) -> None:
        self.f, self.seen, self.size = f, {}, 0

    def __call__(self, t: str):
        if t not in self.seen:
            self.size += len(t)
            if self.size > CACHE_CHARS:
                self.seen.clear()
                self.size = len(t)
            self.seen[t] = self.f(t)
        return self.seen[t]


def places(df: DataFrame, path: str = "file_path", whole: str = "raw_content", part: str = "code") -> DataFrame:
    """Distinct (path, line_no bigint) of the lines in which a credential value begins, in `whole` or else in `part`."""
    src = df.select(F.col(f"`{path}`").alias("p"), F.coalesce(F.col(f"`{whole}`"), F.col(f"`{part}`")).alias("t")).where("t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Once(line_numbers)  # the rows of a file follow each other and repeat its text
        for batch in batches:
            paths, lines = [], []
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = numbers(t.as_py())
                paths += [p] * len(at)
                lines += at
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.int64())], names=[path, "line_no"])

    return src.mapInArrow(run, f"`{path}` string, line_no bigint").distinct()


def redacted(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, *texts) with the values replaced; a row for each row."""
    src = df.select(F.col(f"`{key}`"), *[F.col(f"`{t}`") for t in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once(redact)

        def one(t: str | None) -> str | None:
            return once(t) if t else t

        for batch in batches:
            cols = [batch.column(0)] + [pa.array([one(t.as_py()) for t in batch.column(i + 1)], pa.string()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *texts])

    return src.mapInArrow(run, src.schema)
