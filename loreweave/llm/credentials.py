"""Problem 5: credentials in indexed files, found and blanked out in place.

A keyword automaton marks the lines worth reading; issuer formats, named assignments,
headers, addresses, connection strings and prose are then matched on those lines only, and
every value is validated by its structure (token alphabets, JWT headers, Basic pairs, key
bodies). Matches are replaced by placeholders of the same length and alphabet, so the
surrounding code keeps its shape: every character but white space, escapes and base64 padding
gives way to a fixed one of its class and script that the match does not hold itself.

Null or empty content gives no finds and comes back as it was; rows with a null id are
kept by ``redact`` and left out of ``find``. Texts are read whole, lines of any length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# What a line must contain, in lower case, to be read at all.
KEYWORDS = (
    "pass pwd secret token bearer credential auth login private key- kennwort contras chiave parola clave senha motdepasse mot_de "
    "apikey api_key api-key api key access_key accesskey access-key license_key licensekey encryption_key encryptionkey signing_key "
    "storage_access akia asia ghp_ gho_ ghs_ ghu_ ghr_ github_pat_ glpat- sk_live sk_test rk_live sk- xox eyj aiza npm_ sg. hf_ "
    "://  sig= signature= curl begin admin _pw pw= (pw pw: x-api-key basic uid= 密码 パスワード пароль"
).split(" ")

LEFT, RIGHT = r"(?<![A-Za-z0-9+/_.-])", r"(?![A-Za-z0-9+/_=-])"
# Formats of known issuers.
ISSUERS = re.compile(
    LEFT
    + r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}"
    + r"|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{16,}"
    + r"|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}"
    + r"|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,})"
    + RIGHT
)
BEGIN_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END_KEY = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BASE64 = re.compile(r"[A-Za-z0-9+/=]+")
KEY_HEADER = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): ")
ESCAPED_BODY = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/=]{16,})+")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zñç]+|\d+")

# Words of names that hold credentials.
SECRET_WORDS = frozenset(
    "password passwd passphrase pass passcode pwd pw secret secrets token bearer credential credentials auth apikey kennwort passwort "
    "contrasena contraseña clave senha psw userpwd accesstoken".split()
)
SECRET_PAIRS = frozenset(
    "api.key access.key secret.key license.key licence.key encryption.key signing.key private.key account.key master.key storage.key "
    "service.key deploy.key chiave.api chiave.segreta chiave.privata parola.chiave parola.ordine de.passe clave.api cle.api".split()
)
# Words that make such a name the name of something else.
ABOUT_WORDS = frozenset(
    "header headers field fields label name names length len uuid id ids file path url uri type min max count ttl expiry expires expiration "
    "policy prefix suffix algorithm hint prompt placeholder column env ref version limit size format rotation hash public regex pattern "
    "scheme endpoint provider mode enabled required kind method service issuer audience scope".split()
)
# Words of names that explain an opaque value.
EXPLAINED = frozenset(
    "checksum sha sha1 sha256 sha512 md5 crc hash digest commit etag integrity uuid guid id ids rev revision fingerprint "
    "version icon image logo cert certificate public anchor thumbprint endpoint".split()
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:(.)\1{3,}|<.*>|\[.*\]|\$.*|\{\{.*|%\(.*|%\w+%|#\{.*|@\w+@|__\w+__|.*\*{3,}.*|.*\.{3,}.*|.*…"
    r"|env[:.(\[].*|vault[:.(/].*|secret[:/].*|ssm[:/].*|op://.*|arn:.*|file:.*|ref\+.*|sops:.*|keyring:.*|kms:.*|os\.environ.*|os\.getenv.*|process\.env.*|getenv.*|System\.getenv.*|ENV\[.*"
    r"|.*(?:example|changeme|change[_-]me|change[_-]it|placeholder|replace[_-]?me|replace[_-]?this|your[_-]|<your|dummy|inserire|insert[_-]?|todo|fixme|redacted|masked|hidden|xxxx|not[_-]?set|unset|fill[_-]?in|goes[_-]here|key[_-]here).*"
    r"|none|null|nil|undefined|true|false|yes|no|empty|secret|password|passwd|token|test|string|str|bytes)$"
)
UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?$")
HEX = re.compile(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")
NOT_VALUE = re.compile(r"(?i)^(?:sha\d+-|sha256:|md5:|data:|https?://|\$2[aby]\$|-----|ssh-(?:rsa|ed25519)|v?\d+(?:\.\d+)+$|\d+(?:ms|s|m|h|d|kb|mb|gb)?$|\d{4}-\d\d-\d\d)")
HOST = re.compile(r"(?i)^(?:[a-z0-9-]+\.)+(?:example|com|org|net|io|dev|lan|local|internal|md|py|ts|js|go|rs|java|rb|sh|c|h|json|ya?ml|toml|ini|html|txt|lock|map)(?::\d+)?$")
WORD_PHRASE = re.compile(r"^[A-Za-z]{3,}(?:[-_. ][A-Za-z]{3,})+[-_.]?\d+[!?#%*&$.]?$")

NAME = r"(?P<name>[A-Za-z_][\w.\-]*)"
ASSIGN = re.compile(
    NAME
    + r"[\"'\]]{0,2}\s*(?::\s*[&*]?(?:'static\s+)?[A-Za-z][\w<>?]*\s*=(?=\s*[rbuf@$]{0,2}[\"'`])|=>|:=|\?\?=|\|\|=|=|:)(?![=~])\s*"
    + r"(?P<val>[rbuf@$]{0,2}(?P<q>\"\"\"|\"|'|`)(?P<quoted>.*?)(?:(?P=q)|$)|%q\((?P<perl>[^)]*)\)|(?P<bare>[^\s\"'`,;<>()\[\]]+(?:\([^)\s]*\))?|[<({\[][^\s,;]*))?"
)
XML_PAIR = re.compile(r"(?:key|name)\s*=\s*[\"']?(?P<name>[\w.\-]+)[\"']?\s+value\s*=\s*[\"']?(?P<v>[^\s\"'>]+)")
USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`]*:(?P<v>[^\s@/\"'`]+)@[\w.-]")
PARAM = re.compile(r"[?&;](?:sig|signature|auth|access_key|access_token|token|api_?key|apikey|key|secret|password|pwd|client_secret|code)=(?P<v>[^\s&\"'`;<>)]{8,})", re.I)
CONNECTION = re.compile(r"(?:^|[;\"'\s=])(?:Pwd|Password|AccountKey|SharedAccessKey|SharedSecret)\s*=\s*(?P<v>[^;\"'`\s]+)", re.I)
HEADER = re.compile(r"(?:Authorization[\"']?\s*[:=,]\s*[\"']?(?P<scheme>Bearer|Basic|Token|ApiKey)\s+|(?:X-Api-Key|X-Auth-Token|Api-Key|X-Access-Token|PRIVATE-TOKEN)[\"']?\s*[:=,]\s*[\"']?)(?P<v>[^\s\"'`,;]+)", re.I)
BEARER = re.compile(r"\b(?:Bearer|Basic)\s+(?P<v>[A-Za-z0-9+/=._~-]{12,})")
CURL = re.compile(r"(?:\s-u|--user)[\s=]+[\"']?[^\s:\"']+:(?P<v>[^\s\"']+)")
NETRC = re.compile(r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S+)")
FLAG = re.compile(r"--(?P<name>[a-z][\w-]*)[= ][\"']?(?P<v>[^\s\"']+)")
CALL = re.compile(r"\b\w*(?:login|authenticate|auth|sign_?in|connect|credentials?)\w*\(\s*(?:\w+\s*[=:]\s*)?([\"'`])[^\"'`]*\1\s*,\s*(?:\w+\s*[=:]\s*)?([\"'`])(?P<v>[^\"'`]{6,})\2", re.I)
SETTER = re.compile(r"\bset\w*(?:Password|Token|Secret|ApiKey|Passphrase)\(\s*([\"'`])(?P<v>[^\"'`]{6,})\1", re.I)
SAID = re.compile(
    r"(?i)\b(?:passwords?|pw|passphrase|passwort|kennwort|login|log-in|credentials?|parola chiave|parola d'ordine|contraseñas?|clave|mots? de passe|senha|access code|api key|secret|pwd|token)\b|密码|口令|パスワード|пароль"
)
USER_SLASH = re.compile(r"^\s*[-*+]\s*`?(?P<user>[A-Za-z][\w.-]*)`?\s*/\s*`?(?P<v>[^\s`/]+?)`?\.?\s*$", re.M)
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"\"\")")
REMARK = re.compile(r"^[ \t]*(?:#|//|--|;|/\*|\*|<!--)[^\n:=]{2,80}:[ \t]+`?(?P<v>[^\s`:]{6,80})`?[ \t]*(?:\*/|-->)?\r?$", re.M)
CONTINUED = re.compile(r"^[\s\"'`)]*(?:\+|\\|\.\.|\.|&|\|\|)?\s*$")
NEXT_STRING = re.compile(r"^\s*(?:[+.&]\s*)?[rbuf@$]{0,2}([\"'`])(?P<v>[^\"'`]*)\1\s*(?P<rest>[\s+\\.&);,]*)$")
NEXT_BARE = re.compile(r"^\s+(?P<v>[^\s\"'`]+)\s*$")
SECRET_FILE = re.compile(r"(?i)(?:^|[/\\])(?:[^/\\]*(?:secret|credential|password|\.htpasswd|\.netrc|\.pgpass|id_rsa)[^/\\]*|secrets?[/\\][^/\\]*)$")
CONFIG_FILE = re.compile(r"(?i)\.(?:ya?ml|ini|cfg|conf|env|properties|toml|json|txt|md)$|\.env[\w.]*$|env\.[\w.]+$")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    # besides, the rules' own words: names that hold credentials, what is said in prose, and calls
    for word in {*KEYWORDS, *SECRET_WORDS, "key", "pw", "access code", "口令", "mots de passe", "log-in", "signin", "sign_in", "connect"}:
        if word:
            found.add_word(word, True)
    found.make_automaton()
    return found


def _words(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def secret_name(name: str) -> bool:
    """Whether a variable or field of this name holds a credential (and isn't about one)."""
    words = _words(name)
    if not words or words[0] in ("max", "min", "num", "no", "public") or any(w in ABOUT_WORDS for w in words[-2:] if w != words[0] or len(words) == 1):
        return False
    return any(w in SECRET_WORDS for w in words) or any(f"{a}.{b}" in SECRET_PAIRS for a, b in zip(words, words[1:])) or (
        words[-1] == "key" and any(w in ("access", "storage", "api", "secret", "private", "license", "encryption", "signing") for w in words)
    )


def _mixed(v: str) -> bool:
    return any(c.islower() for c in v) and any(c.isupper() for c in v)


def credential_value(v: str) -> bool:
    """Whether a value under a telling name is the credential itself, not a placeholder, reference, name, id or number."""
    if len(v) < 6 or PLACEHOLDER.match(v) or NOT_VALUE.match(v) or UUID.match(v) or HOST.match(v) or " " in v.strip():
        return False
    if ISSUERS.fullmatch(v):
        return True
    digit, letter = any(c.isdigit() for c in v), any(c.isalpha() for c in v)
    if not letter:
        return not digit and len(v) >= 8 and len(set(v)) >= 4 and all(c in "!@#%*?&$^~+=" for c in v)
    if digit:
        return not re.fullmatch(r"[A-Za-z]+[-_/]v?\d{1,2}", v) and not re.fullmatch(r"[a-z_]+\(.*", v)
    special = any(c in "!@#%*?&$^~+=" for c in v)
    core = re.sub(r"^[a-z]{2,5}[._-]", "", v)  # tokens of many issuers begin with a short name
    switches = sum(a.islower() != b.islower() for a, b in zip(core, core[1:]) if a.isalpha() and b.isalpha())
    return special and len(v) >= 8 or len(core) >= 16 and switches >= 5 and "_" not in core and "-" not in core


def passwordish(v: str) -> bool:
    """Whether a word of prose looks like a password and nothing else."""
    if not credential_value(v) or not any(c.isdigit() for c in v) or re.search(r"[/\\()<>{}|=]", v) and not v.endswith("="):
        return False
    if re.fullmatch(r"[A-Za-z0-9_-]+(?:\.[a-z]{1,5})+", v) and re.search(r"\.(?:[a-z]{1,5})$", v):
        return False
    if re.fullmatch(r"[A-Z]{2,6}-\d+|v?\d[\d.:-]*[a-z]{0,3}|\d+(?:st|nd|rd|th)|[a-z]+\d{1,2}|[A-Z]\d", v):
        return False
    return bool(WORD_PHRASE.match(v)) or _mixed(v) or any(c in "!@#%*?&$^~" for c in v)


def opaque_value(v: str) -> bool:
    """Whether a value under any name of a secrets file is unexplained and opaque."""
    if not credential_value(v) or v.count("/") > 1 and not re.fullmatch(r"[A-Za-z0-9+/]{16,}={0,2}", v):
        return False
    return bool(HEX.match(v) or ISSUERS.search(v) or WORD_PHRASE.match(v) or len(v) >= 8 and any(c.isdigit() for c in v) and _mixed(v) or len(v) >= 12 and _mixed(v) or any(c in "!@#%*?&$^" for c in v))


def _jwt_or_other(v: str) -> bool:
    if not v.startswith("eyJ"):
        return not PLACEHOLDER.match(v)
    try:
        head = v.split(".")[0]
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _basic_pair(v: str) -> bool:
    try:
        user, colon, word = base64.b64decode(v + "=" * (-len(v) % 4)).decode().partition(":")
    except (ValueError, binascii.Error):
        return False
    return bool(colon and user and len(word) >= 4 and word.isprintable() and not PLACEHOLDER.match(word))


def _line_finds(line: str, config: bool, keeps: bool, prose: bool) -> Iterator[tuple[int, int]]:
    """Spans of credentials that stand whole on one line."""
    for m in ISSUERS.finditer(line):
        if _jwt_or_other(m.group()):
            yield m.span()
    for m in HEADER.finditer(line):
        scheme = (m["scheme"] or "").lower()
        if _basic_pair(m["v"]) if scheme == "basic" else credential_value(m["v"]):
            yield m.span("v")
    for m in BEARER.finditer(line):
        if _basic_pair(m["v"]) if m.group().startswith("Basic") else credential_value(m["v"]):
            yield m.span("v")
    if "://" in line:
        for m in USERINFO.finditer(line):
            if len(m["v"]) >= 3 and not PLACEHOLDER.match(m["v"]) and m["v"] not in ("password", "pass", "secret", "user"):
                yield m.span("v")
        for m in PARAM.finditer(line):
            if credential_value(m["v"]) and (len(m["v"]) >= 16 or passwordish(m["v"])):
                yield m.span("v")
    for rx in (CONNECTION,) * (";" in line) + (CURL, NETRC, CALL, SETTER):
        for m in rx.finditer(line):
            if not PLACEHOLDER.match(m["v"]) and (credential_value(m["v"]) or rx in (CURL, NETRC) and len(m["v"]) >= 6):
                yield m.span("v")
    for rx in (XML_PAIR, FLAG):
        for m in rx.finditer(line):
            if secret_name(m["name"]) and credential_value(m["v"]):
                yield m.span("v")
    comment = bool(COMMENT.match(line))
    for m in ASSIGN.finditer(line):
        group = next((g for g in ("quoted", "perl", "bare") if m[g] is not None), None)
        if group is None:
            continue
        v = m[group]
        if group == "bare":
            if not (config or comment or prose) and line[m.end() :].strip(" ;,)}"):
                continue
            cut = v.rstrip("}),;") if comment or prose else v
            v = cut if credential_value(cut) else v.rstrip("}),;")
            if not (config or comment or prose) and not (passwordish(v) and not re.fullmatch(r"[\w.]+", v)):
                continue
        start = m.start(group)
        if secret_name(m["name"]) and credential_value(v) or keeps and not EXPLAINED & set(_words(m["name"])) and not NOT_VALUE.match(v) and opaque_value(v):
            yield start, start + len(v)
    if prose or comment:
        m = USER_SLASH.match(line)
        if m and passwordish(m["v"]):
            yield m.span("v")
            return
        m = REMARK.match(line) if comment else None
        if m and passwordish(m["v"]) and not re.fullmatch(r"[\w.-]+@v?[\da-f.]{4,}", m["v"]) and not EXPLAINED & set(_words(line[: m.start("v")])):
            yield m.span("v")
        elif SAID.search(line):
            for w in re.finditer(r"[^\s`\"'<>,;()\[\]]+", line):
                v = w.group().rstrip(".:")
                if passwordish(v) and "://" not in v and "=" not in v.rstrip("=") and not HOST.match(v):
                    yield w.start(), w.start() + len(v)


def _continued(lines: list[str], n: int, keeps: bool) -> tuple[int, tuple[int, list[tuple[int, int, int]]] | None]:
    """A value that begins or goes on beyond the line of its name: the line where reading ended, and (first line, (line, start, end) of each part)."""
    line = lines[n]
    m = None
    for m in ASSIGN.finditer(line):
        pass
    if m is None or not secret_name(m["name"]):
        return n, None
    parts: list[tuple[int, int, int]] = []
    if m["quoted"] is not None:
        if not CONTINUED.match(line[m.end() :]) or not m["quoted"]:
            return n, None
        parts.append((n, *m.span("quoted")))
    elif m["bare"] is None:
        if line[m.end() :].strip() not in ("", "(", "|", ">", "|-", ">-", "\\", "["):
            return n, None
    elif m["bare"] not in ("(", "|", ">", "|-", ">-", "\\", "[", "{") or line[m.end() :].strip():
        return n, None
    k = n + 1
    while k < len(lines):
        s = NEXT_STRING.match(lines[k])
        b = NEXT_BARE.match(lines[k]) if not s and (not parts or parts[0][0] != n) and m["quoted"] is None else None
        if s:
            parts.append((k, *s.span("v")))
            if ")" in s["rest"] or ";" in s["rest"] or "," in s["rest"]:
                break
        elif b and ":" not in b["v"] and b["v"] not in ("(", "|", ">") and not ((name := ASSIGN.match(b["v"])) and secret_name(name["name"])):
            parts.append((k, *b.span("v")))
        else:
            break
        k += 1
    value = "".join(lines[k][a:b] for k, a, b in parts)
    if len(parts) + (parts[:1] != [] and parts[0][0] != n) < 2 or not credential_value(value):
        return k, None
    return k, (parts[0][0], parts)


def _key_line(line: str, least: int) -> bool:
    """Whether a line can stand in the body of a key: base64 in pieces of ``least`` characters and more but for the last, a header or nothing."""
    t = re.sub(r"\\[nr]|[\"'`,;\\]", " ", line).strip(" \t\r.()#*>|&-")
    pieces = [w for w in t.split() if w not in ("+", "//", "*")]
    if KEY_HEADER.match(t):
        return True
    return all(BASE64.fullmatch(w) for w in pieces) and all(len(w) >= least for w in pieces[:-1]) and (least == 0 or not pieces or len(pieces[-1]) >= least or pieces[-1].endswith("="))


def _key_end(text: str, at: int) -> tuple[int, int]:
    """End of the body of a key that begins at ``at``, and of its END mark; without one, the end of the last line of a body."""
    stop, begin = END_KEY.search(text, at), BEGIN_KEY.search(text, at)
    if stop and not (begin and begin.start() < stop.start()):
        body = text[at : stop.start()]
        long = sum(len(w) for w in BASE64.findall(body.replace("\\n", " ")) if len(w) >= 16)
        if all(_key_line(x, 0) for x in body.split("\n")) or long >= 0.6 * len(re.sub(r"\s", "", body)):
            return stop.start(), stop.end()
    end = at
    for n, line in enumerate(text[at:].split("\n")):
        if not _key_line(line, 16):
            # code may follow on the line of the mark itself, as in one-line JSON
            m = ESCAPED_BODY.match(line) if n == 0 else None
            return (end + m.end(), end + m.end()) if m else (max(end - 1, at), max(end - 1, at))
        end += len(line) + 1
    return len(text), len(text)


def _keys(text: str) -> tuple[list[tuple[int, int, int]], str]:
    """Private keys: (place of the BEGIN mark, start and end of the body), and the text with marks and bodies of keys as spaces."""
    if "PRIVATE KEY" not in text:
        return [], text
    found, parts, at = [], [], 0
    while key := BEGIN_KEY.search(text, at):
        end, rest = _key_end(text, key.end())
        body = re.sub(r"\\n|\s|[\"'`+,]", "", text[key.end() : end])
        if len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 20 and not PLACEHOLDER.match(body[:60]):
            found.append((key.start(), key.end(), end))
        else:
            rest = key.end()
        parts += [text[at : key.start()], re.sub(r"[^\r\n]", " ", text[key.start() : rest])]
        at = rest
    return found, "".join([*parts, text[at:]])


def find_spans(text: str, path: str | None, kind: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Credentials of one text: (line number from 1, start, end) in characters; a private key gives its whole body."""
    keys, text = _keys(text)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    path = (path or "").replace("\\", "/")
    keeps = bool(SECRET_FILE.search(path))
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    hits = range(len(lines)) if keeps else sorted(
        {bisect_right(starts, end) - 1 for end, _ in automaton.iter(low)} | {bisect_right(starts, m.start("v")) - 1 for rx in (REMARK, USER_SLASH) for m in rx.finditer(text)}
    )
    config, prose = bool(CONFIG_FILE.search(path)) or not path, kind == "wiki"
    out = [(bisect_right(starts, begin), a, b) for begin, a, b in keys]
    upto = 0  # lines below are parts of a value already read; none of them names another
    for n in hits:
        line, at = lines[n], starts[n]
        spans = [(at + a, at + b) for a, b in _line_finds(line, config, keeps, prose)]
        more = None
        if n >= upto:
            upto, more = _continued(lines, n, keeps)
        if more:
            out.append((more[0] + 1, starts[more[1][0][0]] + more[1][0][1], starts[more[1][0][0]] + more[1][0][2]))
            out.extend((0, starts[k] + a, starts[k] + b) for k, a, b in more[1][1:])
            spans = [s for s in spans if s[0] < starts[more[1][0][0]] and more[1][0][0] != n]
        out.extend((n + 1, a, b) for a, b in spans)
    return out


ESCAPE = re.compile(r"(\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.?)", re.S)
KEY_RUN = re.compile(r"[A-Za-z0-9+/]{4,}|[A-Za-z0-9]+")
# Placeholders by alphabet (lower, upper, digits, signs), the first that the match does not hold is taken.
ALPHABETS = (
    (re.compile(r"(?=.*\d)[0-9a-f]{8,}"), ("abcdef", "", "0123456789", "")),
    (re.compile(r"(?=.*\d)[0-9A-F]{8,}"), ("", "ABCDEF", "0123456789", "")),
    (re.compile(r"(?=.*[2-7])[A-Z2-7]{8,}=*"), ("", "XYZWVUTSRQPONMLKJIHGFEDCBA", "234567", "")),
    (re.compile(r"(?=.*[0-9A-Z])[A-Za-z0-9+/]{12,}={0,2}"), ("xyzwvutsrqponmlkjihgfedcba", "XYZWVUTSRQPONMLKJIHGFEDCBA", "0123456789", "xyzwvutsrqponmlkjihgfedcba")),
)
ANY = ("xyzwvutsrqponmlkjihgfedcba", "XYZWVUTSRQPONMLKJIHGFEDCBA", "0123456789", "_-.~")


@lru_cache(4096)
def _stand_ins(script: str, category: str) -> str:
    """The first characters of a script and category beyond ASCII."""
    found = []
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.category(c) == category and unicodedata.name(c, "").split(" ")[0] == script:
            found.append(c)
            if len(found) == 16:
                break
    return "".join(found)


def placeholder(value: str, alphabet: str | None = None) -> str:
    """As many characters of the same alphabet: hex stays hex, base32 base32, base64 base64, other letters stay in their script and case.

    White space, escapes, and the padding of base32 and base64 stay; of all else nothing stays in its place but where a match
    holds all characters of a class (long keys), whose placeholder then is the first one.
    """
    lower, upper, digits, signs = next((x for rx, x in ALPHABETS if rx.fullmatch(value)), ANY) if alphabet is None else ALPHABETS[3][1]
    padded = signs != ANY[3]
    held = set(value)
    pick = lambda some, spare: next((c for c in some if c not in held), some[0]) if some else spare
    small, sign = pick(lower, "x"), pick(signs, "_")
    # where a match holds all digits, a letter of its alphabet takes their place
    by_class = {"l": small, "u": pick(upper, "X"), "d": digits[0] if held.issuperset(digits + lower + upper) else pick(digits + lower + upper, "0")}

    def one(c: str) -> str:
        if c.isspace() or c == "=" and padded:
            return c
        if c.isascii():
            return by_class["d" if c.isdigit() else "u" if c.isupper() else "l"] if c.isalnum() else sign
        kind = unicodedata.category(c)
        if kind[0] not in "LMN":
            return sign
        others = _stand_ins(unicodedata.name(c, "").split(" ")[0], kind)
        return next((x for x in others if x not in held), others[0] if others and others[0] != c else by_class["u" if c.isupper() else "d" if c.isdigit() else "l"])

    return "".join(one(c) for c in value)


def _escaped(part: str, change: Callable[[str], str]) -> str:
    """A text with all but its escapes changed; what an escape stands for becomes an x."""
    out = []
    for k, piece in enumerate(ESCAPE.split(part)):
        if k % 2 == 0:
            out.append(change(piece))
        elif piece[1:2] in ("u", "x") and len(piece) > 2:
            out.append(piece[:2] + "78".rjust(len(piece) - 2, "0"))
        else:
            out.append(piece)
    return "".join(out)


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by a placeholder of its length and alphabet; escapes and line ends stay.

    In the body of a private key, which may be a string cut into lines of code, only its letters, digits and base64 runs are replaced.
    """
    at, out = 0, []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b > at:
            a = max(a, at)
            key = BEGIN_KEY.search(text, max(0, a - 64), a) is not None and text[a - 5 : a] == "-----"
            change = (lambda x: KEY_RUN.sub(lambda m: placeholder(m.group(), "base64"), x)) if key else placeholder
            out += [text[at:a], _escaped(text[a:b], change)]
            at = b
    return "".join([*out, text[at:]])


def _slim(chunks: DataFrame) -> DataFrame:
    for c in ("file_path", "kind"):
        if c not in chunks.columns:
            chunks = chunks.selectExpr("*", f"cast(null as string) as {c}")
    return chunks.select("id", "content", "file_path", "kind")


def find_credentials(chunks: DataFrame) -> DataFrame:
    """Lines on which a credential begins: ``id``, ``line_no``, ``n_found``; one row per line, repeated rows once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for pdf in batches:
            ids, nos, ns = [], [], []
            for key, text, path, kind in zip(pdf["id"], pdf["content"], pdf["file_path"], pdf["kind"]):
                lines: dict[int, set] = {}
                for n, a, b in find_spans(text, path, kind, automaton):
                    if n:
                        lines.setdefault(n, set()).add(a)
                for n, found in lines.items():
                    ids.append(key)
                    nos.append(n)
                    ns.append(len(found))
            if ids:
                yield pd.DataFrame({"id": ids, "line_no": nos, "n_found": ns})

    slim = _slim(chunks).where("id is not null and content is not null and content <> ''")
    found = spread(slim, "id").mapInPandas(scan, "id bigint, line_no int, n_found int")
    return found.groupBy("id", "line_no").agg({"n_found": "max"}).withColumnRenamed("max(n_found)", "n_found")


def redact_credentials(chunks: DataFrame) -> DataFrame:
    """Every row of ``chunks`` with ``content`` blanked where credentials stood, and ``n_redacted`` (a column of that name is replaced).

    The text goes through Python alone; all other columns stay where they are.
    """
    path = F.col("file_path") if "file_path" in chunks.columns else F.lit(None).cast("string")
    kind = F.col("kind") if "kind" in chunks.columns else F.lit(None).cast("string")

    @F.pandas_udf("content string, n int")
    def clean(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for contents, paths, kinds in frames:
            rows = []
            for text, where, what in zip(contents, paths, kinds):
                spans = find_spans(text, where, what, automaton) if text else []
                rows.append((blank(text, spans) if spans else text, len({s[1] for s in spans if s[0]})))
            yield pd.DataFrame(rows, columns=["content", "n"])

    kept = [c for c in chunks.columns if c not in ("content", "n_redacted")]
    done = chunks.select(*kept, clean(F.col("content"), path, kind).alias("__redacted"))
    return done.select(*kept, F.col("__redacted.content").alias("content"), F.col("__redacted.n").alias("n_redacted"))
