"""Credentials embedded in source code (problem 1).

Literals and configuration values near an assignment, a call, a header, a URL or a comment that speaks of credentials are
segmented by Viterbi into dictionary words: placeholder and field words, the words of the name itself and, for values of letters alone
under names that may also label something, the whole words of a public tokenizer's vocabulary. What no word explains is the residual; a residual long enough for its context is a secret. Known hash formats, references, masks, public
keys and certificates are left out. Values are looked at as written, joined from the literals of a line, and decoded.

Only lines that hold one of the hints are read closely. Redaction replaces the characters of the value by `*`, so that lengths,
quotes and all other text stay.
"""

from __future__ import annotations

import base64
import binascii
import os
import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.code import extension, per_text


class Secret(NamedTuple):
    line: int
    start: int
    end: int
    kind: str


# Words that placeholders, labels and messages consist of.
WORDS = set(
    "your my the a an enter insert example sample dummy placeholder change changeme me this here todo fixme tbd replace with replaceme fill in set value values secret secrets password passwords passwd passphrase pass pwd pw token tokens key keys "
    "api apikey auth user username name login access private public account credential credentials some test testing none null nil undefined empty redacted hidden masked removed default foo bar baz string text generic fake mock not real "
    "required missing invalid wrong must be at least characters forgot reset new old confirm again please admin root guest db database app service client server smtp mail aws encryption signing master session cookie jwt bearer basic oauth "
    "id ids env environment config variable vault and or of for to is passwort senha mot de passe kennwort contrasena clave abc abcd xyz qwerty unset unknown optional na goes provide add put own use type header field label x".split()
)
# Passwords in common use, although they consist of words and runs.
WEAK = set(
    "letmein admin123 admin1234 password1 password123 passw0rd p@ssw0rd p@ssword welcome1 welcome123 qwerty123 1q2w3e4r iloveyou monkey dragon sunshine princess football baseball trustno1 superman batman starwars shadow master123 root123 "
    "test1234 abc123 111111 123123 654321 12345678 123456789 1234567890 123456 letmein1 hunter2 changeit toor".split()
)
# Words of names.
PASSWORDS = set("password passwd pass pwd pw passphrase passwort kennwort senha passe contrasena contraseña clave haslo hasło wachtwoord sifre şifre parola пароль 密码 パスワード 비밀번호".split())
SECRETS = set("secret secrets token cred creds credential credentials auth apikey authtoken accesskey secretkey privatekey salt jwt pat apitoken".split())
KEY_PLAIN = set("public primary foreign sort cache partition index group row map object dict lookup short unique composite hot press code up down event query config storage column json sheet shift registry".split())
NOT_NAMES = set(
    "label header headers name names field fields hint placeholder prompt title text url uri path file filename length len min max count size type kind expiry expires ttl id ids hash hashed digest checksum sha sha256 sha512 md5 integrity fingerprint policy "
    "regex pattern public env var ref error message msg format prefix suffix enabled required strength rotation reset mode method scheme provider column param arg input form page endpoint issuer audience algorithm alg lifetime limit index version label class".split()
)
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_(?P<a>[A-Za-z0-9]{30,})|github_pat_(?P<b>\w{40,})|glpat-(?P<c>[\w-]{16,})|xox[abeoprs]-(?P<d>[\w-]{20,})|[rs]k_(?:live|test)_(?P<e>[A-Za-z0-9]{16,})|(?:AKIA|ASIA|ABIA|ACCA)(?P<f>[A-Z0-9]{16})(?![A-Z0-9])"
    r"|AIza(?P<g>[\w-]{35})|npm_(?P<h>[A-Za-z0-9]{30,})|SG\.(?P<i>[\w-]{16,}\.[\w-]{16,})|eyJ(?P<j>[\w-]{8,}\.[\w-]{8,}\.[\w-]{16,})|pypi-(?P<k>[\w-]{40,})|hf_(?P<l>[A-Za-z0-9]{30,})|sk-(?P<m>[\w-]{32,})|dop_v1_(?P<n>[a-f0-9]{60,})|shpat_(?P<o>[a-f0-9]{30,})|ya29\.(?P<p>[\w-]{20,})|AccountKey=(?P<q>[A-Za-z0-9+/=]{40,}))"
)
URL = re.compile(r"(?<=[a-zA-Z0-9+.-]{2})://(?P<u>[^\s:/@'\"`<>|]*):(?P<v>[^\s/'\"`|]+)@[\w.\[-]")
USERHOST = re.compile(r"(?:^|[\s'\"`=])(?P<u>[\w.-]{2,}):(?P<v>[^\s:/'\"`|<>]{6,})@[\w-]+(?:\.[\w-]+)+")
QUERY = re.compile(r"[?&](?:api_?key|access_?token|auth_?token|token|key|secret|client_secret|password|pwd|sig|signature|apikey)=(?P<v>[^&\s'\"`|<>]{6,})", re.I)
CONN = re.compile(r"(?:^|[;\s'\"`])(?:password|pwd|passwd|AccountKey|SharedAccessKey|secret)=(?P<v>[^;'\"`\s()][^;'\"`()]{2,})(?=;)", re.I)
HEADER = re.compile(r"\b(?:Bearer|token)\s+(?P<v>[\w.~+/=-]{16,})|\bBasic\s+(?P<b>[A-Za-z0-9+/]{8,}={0,2})|\b(?:X-)?(?:Api-?Key|Auth-?Token|Access-?Token|Vault-Token|Secret|Goog-Api-Key)\s*:\s*(?P<w>[\w.~+/=-]{12,})", re.I)
COMMAND = re.compile(
    r"\bsshpass\s+-p\s*['\"]?(?P<c>[^\s'\"`]+)|\s--?(?:password|passwd|pass|token|api-key|secret|access-token)[= ]['\"]?(?P<d>[^\s'\"`$-][^\s'\"`]{3,})|\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<f>\S+)"
)
#: Commands and their options, which may stand anywhere behind them.
OPTIONS = [
    (re.compile(r"\bcurl\b"), re.compile(r"\s(?:-u|--user)[ =]?['\"]?[\w.-]+:(?P<v>[^\s'\"`]+)")),
    (re.compile(r"\b(?:mysql|mysqldump|mariadb|mycli)\b"), re.compile(r"\s-p(?P<v>[^\s'\"`]{3,})")),
    (re.compile(r"\bredis-cli\b"), re.compile(r"\s-a\s+(?P<v>[^\s'\"`]+)")),
]
COMMENT = re.compile(r"(?:(?<![\w-])(?P<n>[\w-]*(?:passw(?:or)?[dt]|passwd|pass|pwd|pw|passphrase|secret|token|key|cred(?:ential)?s?|senha|kennwort|mot de passe|apikey))\s*(?:[:=]|\bis\b)\s*(?=\S)|\b(?:login|credentials|account|user)\s+(?P<u>[\w.@-]+)\s*/\s*(?=\S))", re.I)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----(?:BEGIN|(?P<end>END)) [A-Z0-9 ]+-----")
# What lines of a key consist of: base64, what may stand around it, and header lines.
KEY_RUN = re.compile(r"[A-Za-z0-9+/=]+")
KEY_TAIL = re.compile(r"[\s\"'`+#*/\\>.,;|()-]*?(?:\b[brBR]{1,2}(?=[\"']))?[\"'`]?(?P<v>[A-Za-z0-9+/]+={0,2})(?:\\[nr]|[\s\"'`+,;.\\)])*")
KEY_BLANK = re.compile(r"(?:[\s\"'`+#*/\\>,;.|-]|\\[nr])*(?:[A-Z][\w-]*: .*)?")
KEY_FIRST = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nr]|[\"'`]\s*[+.]?\s*[\"'`]|[ \t](?=[A-Za-z0-9+/=]{16}))*")
CALL = re.compile(r"(?:\b|_|-)(?:connect|login|log_in|signin|sign_in|authenticate|auth|open_session|set_credentials|credentials|basic_auth|bind|createConnection|getConnection)\s*(?:\(|\s(?=['\"]))\s*", re.I)
REFERENCE = re.compile(
    r"^(?:\$|%[A-Za-z_]\w*%|\{\{|<|op://|vault[:/]|env[:(]|ref\+|arn:|secretsmanager|ssm:|kv[:/]|!(?:vault|Ref|Sub|GetAtt|ImportValue|secret|env)\b|@Microsoft|ENC\[|file:|/(?:run|etc|var|home|opt|usr|tmp|mnt|secrets|root|app|srv)\b|\.{1,2}/|~/|process\.|os\.|getenv|System\.|config\.|keyring:|aws-sm|gcp-sm|akv:|doppler|\(|\[|\{)|\$\{|\{\{|#\{|\$\(|<[\w -]+>?$|%\(|\{\w*\}|^(?:true|false|null|none|nil|yes|no|on|off)$",
    re.I,
)
HASHES = re.compile(r"^(?:sha(?:1|256|384|512)[-:=]|md5[-:=]|\$2[aby]\$|\$argon2|\$[156]\$|pbkdf2|scrypt:|data:|urn:|\{SSHA\})", re.I)
UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
B64 = re.compile(r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])")
LITERAL = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`((?:[^`\\]|\\.)*)`")
CONCAT = re.compile(r"([\"'`])\s*\+\s*\1|(?<=[\"'])\s+\.\s+(?=[\"'])")
# A line without any of these, in lower case, and without a run of base64 that decodes can't hold a credential that is looked
# for. The words of names and, for each pattern above, a part of every alternative.
HINTS = sorted(
    PASSWORDS
    | SECRETS
    | set(
        "key gho_ ghp_ ghu_ ghs_ ghr_ github_pat glpat xox k_live k_test akia asia abia acca aiza npm_ sg. eyj pypi- hf_ sk- dop_v1 shpat ya29 :// @ sig sharedaccesskey bearer basic curl mysql mariadb mycli redis-cli machine "
        "login account user -----begin connect log_in signin sign_in authenticate open_session bind createconnection getconnection".split()
    )
)


@lru_cache(1)
def _hints():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in HINTS:
        a.add_word(w, 0)
    a.make_automaton()
    return a


def _hinted(text: str) -> list[int]:
    """The starts of the lines worth reading."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    starts, until = [], -1
    for e, _ in _hints().iter(low):
        if e > until:
            starts.append(text.rfind("\n", 0, e + 1) + 1)
            until = text.find("\n", e)
            if until < 0:
                break
    until = -1
    for m in B64.finditer(text):
        if m.start() > until and (m.end() - m.start() >= 24 or _decoded(m[0])):
            starts.append(text.rfind("\n", 0, m.start() + 1) + 1)
            until = text.find("\n", m.start())
            if until < 0:
                break
    return sorted(set(starts))


#: Literals before a literal from which on its name is looked for.
BEFORE = 4
#: The vocabulary whose whole words are dictionary words; a parameter, without the file there are none.
VOCABULARY = os.environ.get("LODEGRAPH_WORDS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The least letters of such a word.
WORD_LEAST = 4


@lru_cache(1)
def vocabulary(path: str = VOCABULARY) -> frozenset[str]:
    """The lower-cased words of letters that are one token behind a space."""
    if not os.path.exists(path):
        return frozenset()
    with open(path, "rb") as f:
        tokens = (base64.b64decode(row.split()[0]) for row in f)
        return frozenset(t[1:].decode().lower() for t in tokens if t[:1] == b" " and len(t) > WORD_LEAST and t[1:].isalpha() and t.isascii())


def unexplained(value: str) -> int:
    """How many letters of a value of letters and separators no word of the vocabulary explains, by Viterbi."""
    words, out = vocabulary(), 0
    for part in words_of(value):
        n = len(part)
        best = [0] * (n + 1)
        for i in range(1, n + 1):
            best[i] = best[i - 1] + 1
            for k in range(WORD_LEAST, i + 1):
                if best[i - k] < best[i] and (part[i - k : i] in words or (k > WORD_LEAST and part[i - 1] == "s" and part[i - k : i - 1] in words)):
                    best[i] = best[i - k]
        out += best[n]
    return out


@lru_cache(50_000)
def words_of(name: str) -> tuple[str, ...]:
    """The lower-cased words of an identifier."""
    return tuple(w.lower() for w in re.findall(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[^\W\d_A-ZÀ-Þ]+", name))


_JOINED = re.compile(r"(password|passwd|passphrase|passwort|(?<!by)(?<!com)pass|pwd|pw|secret|token|credentials?|(?:api|access|secret|private|encryption|signing|master|auth))(key)?$")


@lru_cache(50_000)
def strength(name: str) -> int:
    """3 for names of passwords, 2 of other secrets, 1 of plain keys, 0 for the rest."""
    w = words_of(name)
    if not w:
        return 0
    if len(w) == 1 and len(w[0]) > 4 and (j := _JOINED.search(w[0])):
        w = (w[0][: j.start()], *(x for x in j.groups() if x)) if j.start() else tuple(x for x in j.groups() if x)
    own = set(w)
    known = any(x in PASSWORDS for x in w), bool(own & SECRETS) or ("key" in own and len(own) > 1 and not own & KEY_PLAIN)
    if own & NOT_NAMES and not (w[-1] == "id" and "access" in own):
        return 0
    if w[-1] == "id":
        return 1
    return 3 if known[0] else 2 if known[1] else 1 if "key" in own or "keys" in own else 0


def residual(value: str, name: str = "") -> int:
    """How many letters and digits of a value no dictionary word explains: Viterbi over words, runs and single characters."""
    v = value.lower()
    n = len(v)
    own = set(words_of(name))
    best = [0.0] * (n + 1)
    left = [0] * (n + 1)
    for i in range(1, n + 1):
        c = v[i - 1]
        loose = not c.isalnum()
        best[i], left[i] = best[i - 1] + (0 if loose else 1), left[i - 1] + (0 if loose else 1)
        for k in range(1, min(14, i) + 1):
            w = v[i - k : i]
            if w in WORDS or w in own:
                # a word costs a little, so that chance hits of short ones don't pay within random text
                cost = best[i - k] + (0.4 if k > 2 else 1.9)
                if cost < best[i]:
                    best[i], left[i] = cost, left[i - k]
            elif k >= 3 and (w == c * k or w in "01234567890123456789" or w in "9876543210" or w in "abcdefghijklmnop"):
                cost = best[i - k] + 0.4
                if cost < best[i]:
                    best[i], left[i] = cost, left[i - k]
    return left[n]


def _random(value: str) -> bool:
    """Whether a value looks generated: long, of several kinds of characters, and not of words."""
    v = re.sub(r"[^A-Za-z0-9]", "", value)
    if len(v) < 12 or len(set(v)) < 7:
        return False
    switches = sum(1 for a, b in zip(v, v[1:]) if (a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()))
    return switches >= max(3, len(v) // 8)


def _decoded(value: str) -> str | None:
    """The printable text that a value encodes, if any."""
    if len(value) < 8 or len(value) % 4:
        return None
    try:
        text = base64.b64decode(value, validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return text if len(text) >= 6 and text.isprintable() and text.isascii() else None


#: Several words of letters, or one word: what a label, a key or an identifier looks like.
_WORDED = re.compile(r"[A-Za-z]+(?:[-_.:/ ][A-Za-z]+)*")


def is_value(value: str, name: str, level: int) -> bool:
    """Whether a literal is a usable credential under a name of that strength."""
    v = value.strip()
    if len(v) < 4 or REFERENCE.search(v) or HASHES.match(v) or "://" in v:
        return False
    if len(set(v)) < 4 or v.endswith(("...", "…", "***")):
        return False
    if (m := FORMATS.search(v)) is not None:
        return residual(m[m.lastgroup]) >= 8 and len(set(m[m.lastgroup])) > 5
    parts = v.split()
    if len(parts) > 4 or (len(parts) > 1 and (not any(c.isdigit() for c in v)) and len(parts) != 4):
        return False
    if (text := _decoded(v)) is not None and re.search(r"[A-Za-z]{3}", text) and not re.search(r"[^\x20-\x7e]", text) and level >= 2:
        clear = text
        if REFERENCE.search(clear) or residual(clear, name) < 4:
            return False
        return True
    if level >= 3 and v.lower() in WEAK:
        return True
    left = residual(v, name)
    if level >= 3:
        return left >= 4
    if level == 2:
        mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
        if left >= 8 and not mixed and _WORDED.fullmatch(v):
            return unexplained(v) >= 8
        return left >= (5 if mixed else 8) or UUID.match(v) is not None
    if level == 1:
        return left >= 16 and _random(v) and not UUID.match(v)
    return False


def _content(line: str) -> list[tuple[int, int, str]]:
    """Credentials that a text shows by its own form: known formats, URLs, connection strings, headers and commands."""
    out = []
    for m in FORMATS.finditer(line):
        own = m[m.lastgroup]
        if len(set(own)) > 5 and residual(own) >= 8 and "EXAMPLE" not in own:
            out.append((m.start(), m.end(), "format"))
    for rx, kind in ((URL, "url"), (USERHOST, "url"), (CONN, "connection"), (QUERY, "url")):
        for m in rx.finditer(line):
            v = m["v"]
            if len(v) >= 3 and not REFERENCE.search(v) and len(set(v)) > 2 and residual(v) >= 4 and not (kind == "url" and v.isdigit()):
                out.append((m.start("v"), m.end("v"), kind))
    for m in HEADER.finditer(line):
        g = m.lastgroup
        v = m[g]
        if g == "b":
            text = _decoded(v)
            if text and ":" in text and not REFERENCE.search(p := text.partition(":")[2]) and residual(p) >= 4:
                out.append((m.start(g), m.end(g), "header"))
        elif residual(v) >= 10 and (_random(v) or FORMATS.search(v)) and not REFERENCE.search(v):
            out.append((m.start(g), m.end(g), "header"))
    given = [m.span(m.lastgroup) for m in COMMAND.finditer(line)]
    for word, option in OPTIONS:
        if c := word.search(line):
            given += [m.span("v") for m in option.finditer(line, c.end())]
    for a, b in given:
        v = line[a:b]
        if not REFERENCE.search(v) and len(set(v)) > 3 and residual(v) >= 4:
            out.append((a, b, "command"))
    return out


_DEFAULT = re.compile(r"(?:get|getenv|env|var|property|default|or)\w*!?\(\s*(?:[\"'`](?P<k>[^\"'`]*)[\"'`]|[\w.]+)\s*,\s*$|\.(?:unwrap_or|or_else|orElse|getOrDefault|unwrap_or_else)\w*\([^()]*$", re.I)
_DIRECT = re.compile(r"(?:(?<![=!<>])=|:=|:|\|\||\?\?|\bor\b|=>|\breturn\b|\?)\s*(?:[bBrRuUfF]{1,2}|(?:String::from|Buffer\.from|SecretStr|Secret|new \w+|Some|str|strdup|String|b64decode|base64\.b64decode|atob)\(|[(\[&]|\bL)*\s*$")
_NAME = re.compile(r"(?<![\w$.-])((?:[^\W\d]|\$)[\w$.-]*+)[\"'`]?\]?\s*(?:\[\d*\]\s*)?(?::\s*[&\w<>\[\]' .|*?]+?)?\s*(?::=|=>|(?<![=!<>])=(?!=)|:)")
_CONFIG = re.compile(
    r"^\s*(?:export\s+|set\s+|ENV\s+|ARG\s+|[-*]\s+)?(?:[`\"']?(?P<k>[\w.\-/:]+?)[`\"']?\s*(?:=|:)\s*(?P<v>.*?)|\|\s*`?(?P<k2>[\w.\- ]+?)`?\s*\|\s*`?(?P<v2>[^|]*?)`?\s*\||<(?P<k3>[\w.\-]+)[^>]*>(?P<v3>[^<]*)</.*)\s*,?\s*(?:\r)?$"
)


def _closing(line: str, lits: list[re.Match]) -> dict[int, int]:
    """The closing parenthesis of each opening one, outside literals."""
    out, open_, k = {}, [], 0
    for m in re.finditer(r"[()]", line):
        while k < len(lits) and lits[k].end() <= m.start():
            k += 1
        if k < len(lits) and lits[k].start() < m.start():
            continue
        if m[0] == "(":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _called(word: str, text: str, args: list, n: int) -> list[tuple[int, int, str]]:
    """The credential among the first literals of a call; n: how many it has."""
    if n < 2 or (n < 3 and not re.search(r"login|auth|credential|sign", word, re.I)):
        return []
    (u, _, _), (v, sp, _) = args[-2:]
    if (n > 2 and not re.fullmatch(r"[\w.-]+(:\d+)?", args[0][0])) or not re.fullmatch(r"[\w.@-]+", u) or not is_value(v, "", 3):
        return []
    return [] if re.search(r"getenv|environ", text) else [(a, b, "call") for a, b in sp]


def _assigned(line: str, code: bool) -> list[tuple[int, int, str]]:
    out = []
    lits = list(LITERAL.finditer(line))
    joined: list[tuple[str, list[tuple[int, int]], int]] = []  # the value, its spans, where it starts
    for m in lits:
        g = m.lastindex
        a, b = m.span(g)
        if joined and re.fullmatch(r"[\"'`]\s*(?:\+|\.|\.\.)\s*[\"'`]", line[joined[-1][1][-1][1] : a]):
            v, sp, st = joined[-1]
            joined[-1] = (v + m[g], [*sp, (a, b)], st)
        else:
            joined.append((m[g], [(a, b)], m.start()))
    first = _NAME.search(line)
    for i, (v, sp, st) in enumerate(joined):
        if not v:
            continue
        before = line[joined[i - BEFORE][1][-1][1] + 1 if i >= BEFORE else 0 : st]
        name = ""
        if d := _DEFAULT.search(before):
            name = (d["k"] if "k" in d.re.groupindex and d["k"] else "") or (first[1] if first else "")
            level = max(strength(name), strength(first[1]) if first else 0)
            near = None
            for near in _NAME.finditer(before):  # of the statement at hand, where a line has several
                pass
            if near and strength(near[1]) > level:
                name, level = near[1], strength(near[1])
        elif _DIRECT.search(before):
            near = None
            for near in _NAME.finditer(before):
                pass
            name = near[1] if near else ""
            level = strength(name.rpartition(".")[2] if code else name)
            if not level and "." in name:
                level = strength(name)
            if near and first and not level and re.search(r"process\.env|\|\||\?\?|\bor\b", before):
                name = first[1]
                level = strength(name)
        else:
            continue
        if level and is_value(v, name, level):
            out += [(a, b, "assignment") for a, b in sp]
    for v, sp, st in joined:
        if len(sp) > 1 and (FORMATS.search(v) or URL.search(v)) and _content(v):
            out += [(a, b, "joined") for a, b in sp]
    starts = [x[2] for x in joined]
    closing: dict[int, int] | None = None
    for c in CALL.finditer(line) if len(joined) > 1 else ():
        at = c.end()
        i = bisect_left(starts, at)
        if len(joined) - i < 2:
            break
        if closing is None:
            closing = _closing(line, lits)
        end = closing.get(line.rfind("(", c.start(), at), len(line))
        # the literals within the parentheses, else all that follow
        k = bisect_left(starts, end)
        out += _called(c[0], line[at:end], joined[i : min(k, i + 3)], k - i) or _called(c[0], line[at:], joined[i : i + 3], len(joined) - i)
    return out


_COMMENT_AT = re.compile(r"(?:^|[\s;{}(])(?://|#|/\*|--|<!--)\s?(?P<c>.*)$|^\s*\*\s(?P<d>.*)$")


def _commented(line: str) -> list[tuple[int, int, str]]:
    m = _COMMENT_AT.search(line)
    if not m:
        return []
    g = "c" if m["c"] is not None else "d"
    body = m[g].removesuffix("*/").removesuffix("-->").rstrip()
    found = list(COMMENT.finditer(body))
    out = []
    for c, then in zip(found, [*found[1:], None]):
        # a value ends where the next name begins, if something parts them
        rest = body[c.end() : then.start() if then and body[then.start() - 1] in " \t,;|&" and then.start() > c.end() else len(body)]
        v = rest.strip().strip("\"'`,;.")
        at = m.start(g) + c.end() + rest.find(v)
        name = c["n"] or "password"
        level = strength(name)
        # words alone are a sentence here, unless they are few and end in a number
        if " " in v and not re.fullmatch(r"(?:[a-z]+ ){1,3}\d{1,4}", v):
            v = v.split()[0].rstrip("\"'`,;")
            if not _random(v) and not (any(x.isdigit() for x in v) and any(x.isalpha() for x in v) and len(v) > 7):
                continue
        if not any(x.isdigit() for x in v) and not _random(v):
            continue
        if is_value(v, name, max(level, 2)):
            out.append((at, at + len(v), "comment"))
    return out


# Kinds of files where an unquoted word is a value, and not a name of the program.
PLAIN = set("sh bash zsh env dockerfile properties ini cfg conf cnf config toml yml yaml".split()) | {""}
#: name=value up to white space, or to the next pair; name: value within braces or behind white space.
_PAIR = re.compile(
    r"(?:^|(?<=[\s;&|({\[,\"'`?]))(?:-[eD](?=\w))?(?P<k>[\w.\-]+)(?:=(?P<v>(?:(?![,;&|][\w.\-]*=|;?</)[^\s\"'`])+)|[\"'`]?\s*:\s+(?P<w>(?:(?!,\s|,$)[^\s\"'`{}\[\]])+))",
)
_ELEMENT = re.compile(r"<(?P<k>[\w.\-]+)(?:\s[^<>]*)?>(?P<v>[^<]+)</")
_SHELL_END = re.compile(r"[;&|<>()]")


def _configured(ext: str, line: str) -> list[tuple[int, int, str]]:
    """Credentials in unquoted values: of the line as a whole, of each name=value or name: value in it, of each element."""
    out = []
    c = _CONFIG.match(line)
    if c:
        g = "" if c["k"] is not None else "2" if c["k2"] is not None else "3"
        v = c["v" + g].strip()
        at = c.start("v" + g) + c["v" + g].find(v)
        if v[:1] in "\"'`" and v[-1:] == v[:1] and len(v) > 1:
            v, at = v[1:-1], at + 1
        k = c["k" + g]
        level = strength(k)
        if level and not (ext == "sh" and re.search(r"[\s$`(;&|<>]", v)) and is_value(v, k, level):
            return [(at, at + len(v), "assignment")]
    inside, seen = False, 0
    for m in _PAIR.finditer(line):
        if not (level := strength(m["k"])):
            continue
        g = "v" if m["v"] is not None else "w"
        v = m[g]
        if ext == "sh":
            v = _SHELL_END.split(v, maxsplit=1)[0]
            if re.search(r"\$[\w{(]", v):
                continue
        v = v.rstrip(";,)}]" if g == "v" else ";,)")
        # in prose and programs a value without digits is a word or a name, unless it looks generated
        if (o := line.rfind("{", seen, m.start())) != (c := line.rfind("}", seen, m.start())):
            inside = o > c
        seen = m.start()
        sure = ext in PLAIN and (g == "v" or inside)
        if not sure and not any(x.isdigit() for x in v) and not _random(v):
            continue
        if re.fullmatch(r"[A-Za-z_][\w.]*[(\[].*", v) or not is_value(v, m["k"], level):
            continue
        out.append((m.start(g), m.start(g) + len(v), "assignment"))
    for m in _ELEMENT.finditer(line):
        v = m["v"].strip()
        if (level := strength(m["k"])) and is_value(v, m["k"], level):
            at = m.start("v") + m["v"].find(v)
            out.append((at, at + len(v), "assignment"))
    return out


def _key_end(text: str, at: int) -> int:
    """Where the private key that begins before at ends: at its END line, else with its base64 text. 0 if no key follows."""
    m = PEM_END.search(text, at)
    if m and m["end"]:
        until = m.start()
    else:
        stop = m.start() if m else len(text)
        until = pos = KEY_FIRST.match(text, at, stop).end()
        while (pos := text.find("\n", pos, stop)) >= 0:
            pos += 1
            e = text.find("\n", pos, stop)
            row = text[pos : stop if e < 0 else e]
            run = max(KEY_RUN.finditer(row), key=lambda r: r.end() - r.start(), default=None)
            if run and len(run[0]) >= 20 and 2 * len(run[0]) >= len(row.strip()):
                until = pos + run.end()
            elif (t := KEY_TAIL.fullmatch(row)) and (len(t["v"]) % 4 == 0 or e < 0):
                until = pos + t.end("v")
                break
            elif not KEY_BLANK.fullmatch(row):
                break
    clear = re.sub(r"\\[nr]|[\s\"'+#*/\\]", "", text[at:until])
    return until if len(re.findall(r"[A-Za-z0-9+/=]", clear)) >= 40 and len(set(clear)) > 12 else 0


_SCHEME = re.compile(r"(?:Bearer|Basic|Token)\s+", re.I)


def _union(line: str, hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The hits without overlaps; the word before a header's value isn't part of it."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(((m.end() if (m := _SCHEME.match(line, a, b)) else a, b, kind) for a, b, kind in hits), key=lambda h: (h[0], -h[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2])
        elif a < b:
            out.append((a, b, kind))
    return out


def find(ext: str, text: str) -> list[Secret]:
    """The credentials of one file, with the offsets of their values. A key block over several lines has the line it begins in."""
    from lodegraph.llm.syntax import LANGUAGES

    code = ext in LANGUAGES
    out: list[Secret] = []
    no, counted, pem_until, n = 1, 0, -1, len(text)
    for pos in _hinted(text):
        no += text.count("\n", counted, pos)
        counted = pos
        e = text.find("\n", pos)
        line = text[pos : n if e < 0 else e]
        line = line.removesuffix("\r")
        if len(line) < 6:  # a name, a sign and a value are longer
            continue
        if pos + len(line) <= pem_until:
            continue
        keys = [(0, pem_until - pos)]  # what key blocks cover of the line
        for m in PEM.finditer(line):
            if pos + m.start() >= pem_until and (until := _key_end(text, pos + m.end())):
                out.append(Secret(no, pos + m.end(), until, "private key"))
                keys.append((m.start(), until - pos))
                pem_until = until
        hits = _content(line)
        for m in B64.finditer(line):
            # an embedded image is no credential, whatever else the line holds
            if not line.endswith(";base64,", 0, m.start()):
                if (clear := _decoded(m[0])) is not None and _content(clear):
                    hits.append((m.start(), m.end(), "encoded"))
        hits += _assigned(line, code) + _commented(line)
        if not code or ext == "sh":
            hits += _configured(ext, line)
        out += [Secret(no, pos + a, pos + b, kind) for a, b, kind in _union(line, hits) if not any(a < y and x < b for x, y in keys)]
    return out


def redact(ext: str, text: str) -> str:
    """The text with the characters of every credential masked; line ends and all else stay."""
    out, done = [], 0
    for a, b in sorted({(s.start, s.end) for s in find(ext, text)}):
        a = max(a, done)
        if b > a:
            out += text[done:a], re.sub(r"[^\s]", "*", text[a:b])
            done = b
    return "".join(out) + text[done:]


def _lines(ext: str, text: str) -> str | None:
    got = sorted({s.line for s in find(ext, text)})
    return " ".join(map(str, got)) or None


def found(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of every line with a credential. Null content has none; redelivered rows count once."""
    own = files.where("file_id is not null and path is not null and content is not null")
    own = own.select("file_id", per_text(_lines, "string", extension(F.col("path")), F.col("content")).alias("s")).where("s is not null")
    return own.select("file_id", F.explode(F.split("s", " ").cast("array<bigint>")).alias("line_no")).distinct()


def redacted(files: DataFrame) -> DataFrame:
    """files with masked content, every row and column kept. A null path counts as one without extension, null content stays null."""
    return files.withColumn("content", per_text(redact, "string", extension(F.coalesce("path", F.lit(""))), F.col("content")))
