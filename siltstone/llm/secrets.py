"""Problem 5: credentials embedded in source code, configuration and notes.

Configuration (JSON, YAML, TOML, INI, properties and XML, and assignments of any language) is parsed
into key paths with the byte offsets of their values; a value is a credential if the name that its
path ends with is sensitive (names that only carry a value, such as ``value`` or ``default``, give way
to the one above) and the value has the shape of one, or if the value alone has the form that an
issuer gives its tokens. Literals
cut into adjacent pieces are read as one value, which begins at its first piece. Connection
addresses, authorization values, private key blocks and notes in prose have patterns of their own.

Redaction splices a marker into the original bytes at exactly these offsets, keeping quotes, the
address around a password and the lines of a key block, so the surrounding code still parses.

NULL and empty texts have no credentials; placeholders, empty values, look-ups, digests, commit ids
and UUIDs are none. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_language
from siltstone.session import spread

MARK = "REDACTED"
# Words that make a key name sensitive, pairs that do so together, words that undo it.
SENSITIVE = frozenset("password passwd pwd pass passphrase passwort secret token apikey authkey credential credentials pat psk pw bearer authorization".split())
PAIRS = frozenset({("api", "key"), ("auth", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("service", "key"), ("license", "key"), ("deploy", "key"), ("master", "key"), ("webhook", "key"), ("db", "pw")})
HARMLESS = frozenset("digest checksum hash sha sha1 sha256 sha512 md5 commit uuid guid etag integrity fingerprint revision rev ref path file name type ttl expiry expires count limit length size url field column regex pattern header label hint policy".split())

# Names of a path that carry the value of the name above them.
CARRIERS = frozenset("value values val default data content plain plaintext text string current raw literal".split())

# Values whose form alone gives them away (fixed values: public token formats of issuers).
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9]{20,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}|hf_[A-Za-z0-9]{30,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|dop_v1_[a-f0-9]{64}|shpat_[a-fA-F0-9]{32}|sq0[a-z]{3}-[A-Za-z0-9_-]{22,}|AC[a-f0-9]{32}|key-[a-f0-9]{32}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ADDRESS = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s/@\"'`<>]+)@[\w\[]")
AUTH = re.compile(r"\b(?:Basic|Bearer|Token|Digest)\s+([A-Za-z0-9+/=_.~-]{12,})|(?i:\b(?:x-[a-z-]*(?:key|token|secret|auth)[a-z-]*|private-token|api-key|apikey)\b[\"']?\s*[:=,]\s*[\"']?)([^\s\"'`,;<>{}()]{8,})")
PROSE = re.compile(r"(?i)\b(?:password|passphrase|passwd|pwd|secret|token|api key|access key|auth key|login|credentials?|passwort|contraseña|mot de passe)\b(?:[^\n`\"']{0,40}?)(?:`([^`\n]+)`|\"([^\"\n]+)\"|'([^'\n]+)')")
PROSE_BARE = re.compile(r"(?i)\b(?:password|passphrase|passwd|pwd|pass|secret|token|api[ _-]?key|access[ _-]?key|auth[ _-]?key|secret[ _-]?key|signing[ _-]?key|private[ _-]?key)\b(?: (?:is|was|now|to|remains|for [\w ]{1,30} is))*\s*(?:[:=]|\bis\b|\bwas\b|->|→)\s*([^\s`\"',;]{8,})")
FLAG = re.compile(r"(?i)(?<![\w-])--?(?:password|passwd|pwd|pass|secret|token|api-?key|auth-?key|access-?key|client-secret)(?:[= ]|\s+)[\"']?([^\s\"'`]{6,})|(?<!\w)-p([^\s\"'`-][^\s\"'`]{7,})|(?<![\w-])(?:-u|--user)[ =]?[\"']?[\w.-]+:([^\s\"'`@]{6,})|\b(?:IDENTIFIED BY|WITH PASSWORD|ENCRYPTED PASSWORD|PASSWORD)\s+'([^'\n]+)'|sshpass\s+-p\s*[\"']?([^\s\"']+)")
_STR = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
ASSIGN = re.compile(
    rf"(?<![\w$+/=])(?P<k>[A-Za-z_$][\w$.-]*)[\"'\]`)]*\s*(?:\[\])?\s*(?::\s*(?:&?'?\w++\s*)?[\w&<>\[\]|? ]*?)?\s*(?::=|=>|==|=|:|,|\)|\s)\s*(?:String::from\(|new String\(|std::string\(|f|b|r|u|@|\()?(?P<v>{_STR})"
)
ENV = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+|-[ \t]+|[#;/*]+[ \t]*(?:export[ \t]+)?)?(?P<k>[A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*(?P<v>[^\s\"'`#(\[{<]\S*)")
JOIN = re.compile(rf"({_STR})(?:\s*(?:\+|\.|\\|<<|\.\.|\|\|)?\s*\n?\s*(?:\+|\.|\|\|)?\s*)(?={_STR})")
_LITERAL = re.compile(_STR)
# Between two lines of a literal cut into pieces: the end of the first is no key of the second.
_CUT = re.compile(r"[\"'`]\s*\n\s*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Plain substrings of the folded text without one of which a pattern cannot match: one of each of its alternatives.
AUTH_SIGNS = ("basic", "bearer", "token", "digest", "x-", "api-key", "apikey")
FLAG_SIGNS = ("-p", "-u", "-secret", "-token", "-api", "-auth", "-access", "-client-secret", "identified by", "password", "sshpass")
PROSE_SIGNS = ("pass", "pwd", "secret", "token", "key", "login", "credential", "contraseña")
# Letters that match i, k and s where case is ignored, but are not lowered to them.
_FOLD = str.maketrans("İıKſ", "iiks")


PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.•_#-]+|0+|1234567\d*|(?:your|my|the|an|a|some)[ _-][\w .-]*"
    r"|(?:insert|enter|put|add|change|replace|example|sample|dummy|fake|test|placeholder|todo|none|null|nil|undefined|redacted|removed|hidden|secret|password|passwd|token|changeme|foo|bar|your)[a-z _.-]*"
    r"|<.*>|\[.*\]|\$.*|%[^%]*%|\{\{.*\}\}|\{.*\}|.*\$\{.*\}.*|.*\{\{.*\}\}.*|.*redacted.*|.*(?:_here|-here| here))$"
)
LOOKUP = re.compile(r"(?i)^(?:process\.env|os\.(?:environ|getenv)|env[.(\[]|getenv|vault[.:/({]|config[.(\[]|settings[.(\[]|secrets?[.(\[]|ssm:|arn:|file:|/run/|/etc/|/var/|ref\+|op://|sops[:/]|kms:)")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+[-:=])|^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$")
_PLAIN = re.compile(r"^[a-z]+(?:[-_./ ][a-z]+)*$|^[A-Z]+(?:[-_./ ][A-Z]+)*$|^\d+(?:\.\d+)*$|^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*$|^v?\d+(?:\.\d+)+$|^[\w.-]+\.(?:com|org|net|json|ya?ml|txt|pem|example|py|js)$")


def key_words(key: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(key)]


_ENDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "accesskey", "authkey", "privatekey", "secretkey", "signingkey", "adminpass", "dbpass", "userpass", "credential", "authheader")
_DIGEST_WORDS = frozenset("digest checksum sha hash uuid commit integrity run etag rev revision fingerprint".split())


def sensitive(key: str) -> bool:
    """A key name that names a credential. A digest's name followed by a bare ``token`` does not."""
    ws = [w for w in key_words(key) if not w.isdigit()]
    if not ws or ws[-1] in HARMLESS:
        return False
    if any(p in PAIRS for p in zip(ws, ws[1:], strict=False)):
        return ws[-1] != "id" or "access" in ws
    strong = [w for w in ws if w in SENSITIVE or (len(w) > 6 and w.endswith(_ENDS))]
    if not strong or (ws[-1] == "id" and "access" not in ws):
        return False
    return strong != ["token"] or ws[0] not in _DIGEST_WORDS


def sensitive_path(path: tuple[str, ...]) -> bool:
    """A key path that names a credential: its last name that is no mere carrier of a value."""
    names = list(path)
    while len(names) > 1 and names[-1].lower() in CARRIERS:
        names.pop()
    return bool(names) and sensitive(names[-1].rsplit(".", 1)[-1])


def credential_like(v: str, *, strong: bool) -> bool:
    """The shape of a credential; ``strong`` when the key name alone already says so."""
    if len(v) < 6 or PLACEHOLDER.match(v) or LOOKUP.match(v) or UUID.match(v) or "://" in v:
        return False
    if any(c.isspace() for c in v) or _PLAIN.match(v) or v.startswith(("sha256", "sha512", "sha1-")):
        return False
    if re.search(r"[(){}\[\]<>;]", v) and not re.search(r"\d", v):
        return False
    if re.search(r"\w\(|\)$|->|::", v):
        return False
    classes = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if strong:
        return bool(re.search(r"[A-Za-z]", v)) and (classes >= 3 or (classes >= 2 and bool(re.search(r"\d", v)) and len(v) >= 8))
    return classes >= 3 and len(v) >= 10 and bool(re.search(r"\d", v)) and not _DIGEST.match(v)


def _json_pairs(text: str):
    """``(path, start, stop)`` of every string value of a JSON text, by a stack of keys."""
    stack: list[str] = []
    key, opened = "", []
    tokens = list(re.finditer(r'"((?:[^"\\\n]|\\.)*)"|[{}\[\],:]', text))
    for i, m in enumerate(tokens):
        c = m.group()
        if c in "{[":
            opened.append(c)
            stack.append(key)
        elif c in "}]":
            if opened:
                opened.pop()
                stack.pop()
        elif c[0] == '"':
            if i + 1 < len(tokens) and tokens[i + 1].group() == ":":
                key = m.group(1)
            elif i and tokens[i - 1].group() in (":", ",", "["):
                yield (*filter(None, stack), key), m.start() + 1, m.end() - 1


_YAML = re.compile(r"^([ \t]*(?:- +)*)(?:([\"']?)([\w./ -]+?)\2 *:(?: +|$))?(.*)$")


def _yaml_pairs(text: str):
    """``(path, start, stop)`` of the scalar values of a YAML text, by indentation."""
    stack: list[tuple[int, str]] = []
    at = 0
    for line in text.split("\n"):
        body = line.rstrip("\r")
        m = _YAML.match(body)
        if m and body.strip() and not body.lstrip().startswith("#"):
            depth = len(m.group(1))
            while stack and stack[-1][0] >= depth:
                stack.pop()
            v, s = m.group(4), m.start(4)
            comment = re.search(r"(?:^|\s)#", v) if v[:1] not in "\"'" else None
            v = (v[: comment.start()] if comment else v).rstrip()
            if m.group(3):
                path = (*(k for _, k in stack), m.group(3))
                stack.append((depth, m.group(3)))
            else:
                path = tuple(k for _, k in stack)
            if v:
                if v[0] in "\"'":
                    end = v.find(v[0], 1)
                    if end > 0:
                        yield path, at + s + 1, at + s + end
                elif v[0] not in "|>&*!{[":
                    yield path, at + s, at + s + len(v)
        at += len(line) + 1


_SECTION = re.compile(r"^[ \t]*\[+[ \t]*([^\]\n]+?)[ \t]*\]+")
_PAIR = re.compile(r"^[ \t]*(?:export[ \t]+)?(?P<k>[\w.\"'-]+)[ \t]*[=:][ \t]*(?P<v>\S.*)?$")


def _ini_pairs(text: str):
    """``(path, start, stop)`` of the values of TOML, INI, properties and env files, by sections."""
    section: tuple[str, ...] = ()
    at = 0
    for line in text.split("\n"):
        body = line.rstrip("\r")
        if m := _SECTION.match(body):
            section = tuple(x.strip("\"' ") for x in m.group(1).split("."))
        elif (m := _PAIR.match(body)) and m.group("v") and body.lstrip()[:1] not in "#;!":
            path, v, s = (*section, m.group("k").strip("\"'")), m.group("v"), m.start("v")
            if inner := list(re.finditer(rf"([\w-]+)[ \t]*=[ \t]*({_STR})", v)) if v[0] == "{" else []:
                for x in inner:  # an inline table
                    yield (*path, x.group(1)), at + s + x.start(2) + 1, at + s + x.end(2) - 1
            elif lit := _LITERAL.match(v):
                yield path, at + s + 1, at + s + lit.end() - 1
            else:
                plain = re.split(r"\s[#;]", v)[0].rstrip()
                yield path, at + s, at + s + len(plain)
        at += len(line) + 1


_TAG = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<(/?)([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>")
_ATTRIBUTE = re.compile(r"([\w.:-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def _xml_pairs(text: str):
    """``(path, start, stop)`` of attributes and of the text of elements; ``name`` or ``key`` attributes name a ``value`` beside them."""
    stack: list[str] = []
    last = 0
    for m in _TAG.finditer(text):
        if m.group(2) is None:
            continue
        body = text[last : m.start()]
        if stack and body.strip():
            a = last + len(body) - len(body.lstrip())
            yield tuple(stack), a, a + len(body.strip())
        last = m.end()
        if m.group(1):
            while stack and stack.pop() != m.group(2):
                pass
            continue
        given = {x.group(1).lower(): x for x in _ATTRIBUTE.finditer(m.group(3))}
        label = next((given[k].group(2)[1:-1] for k in ("name", "key", "id", "property") if k in given), None)
        for k, x in given.items():
            a = m.start(3) + x.start(2) + 1
            yield (*stack, m.group(2), *([label] if label and k in CARRIERS else []), k), a, a + len(x.group(2)) - 2
        if not m.group(4):
            stack.append(label or m.group(2))


_FORMS = {"json": _json_pairs, "yaml": _yaml_pairs, "toml": _ini_pairs, "ini": _ini_pairs, "xml": _xml_pairs}
_FORM_OF = {"toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "ini", "env": "ini", "xml": "xml", "config": "xml", "plist": "xml", "json": "json", "yml": "yaml", "yaml": "yaml"}


def form_of(path: str | None, language: str | None) -> str | None:
    """The configuration format of a file: its language, else what its extension says."""
    if language in ("json", "yaml"):
        return language
    ext = (path or "").lower().replace("\\", "/").rsplit("/", 1)[-1].rpartition(".")[2]
    return _FORM_OF.get(ext) if language in (None, "unknown", "text") else None


def _joined(text: str, start: int, stop: int):
    """The literal at ``start`` (with quotes) and those cut off after it: its value and pieces."""
    pieces, value, at = [(start + 1, stop - 1)], text[start + 1 : stop - 1], start
    while m := JOIN.match(text, at):
        nxt = _LITERAL.match(text, m.end())
        if not nxt or text[m.end(1) : m.end()].count("\n") > 1 or (text[m.end(1) : m.end()].strip() == "" and text[m.end(1) : m.end()] == ""):
            break
        pieces.append((nxt.start() + 1, nxt.end() - 1))
        value += text[nxt.start() + 1 : nxt.end() - 1]
        at = m.end()
    return value, pieces


def _scan(text: str, language: str | None, add) -> None:
    low = (text if text.isascii() else text.translate(_FOLD)).lower()
    for m in ISSUED.finditer(text):
        body = m.group().split("_")[-1]
        if not re.fullmatch(r"(?i)[x*.0-]+|.*(?:example|xxxx|0000000|your|here).*", body) and re.search(r"\d|[A-Z]", body):
            add(m.start(), m.end(), "issued_token")
    for m in ADDRESS.finditer(text) if "://" in text else ():
        v = m.group(1)
        if not PLACEHOLDER.match(v) and not LOOKUP.match(v) and "$" not in v[:1] and "{" not in v:
            add(m.start(1), m.end(1), "address_password")
    for m in AUTH.finditer(text) if any(t in low for t in AUTH_SIGNS) else ():
        g = 1 if m.group(1) else 2
        if credential_like(m.group(g), strong=True) and not ISSUED.match(m.group(g)):
            add(m.start(g), m.end(g), "authorization")
    if language != "json":
        at = 0
        while m := ASSIGN.search(text, at):
            at = m.end("k")
            named = sensitive(m.group("k")) and not _CUT.fullmatch(text, m.end("k"), m.start("v"))
            if not named and "\n" not in text[m.end("v") : m.end("v") + 4] and "+" not in text[m.end("v") : m.end("v") + 4] and text[m.end("v") : m.end("v") + 2].strip()[:1] not in ("+", ".", "\"", "'", "\\"):
                continue
            value, pieces = _joined(text, m.start("v"), m.end("v"))
            if (named and credential_like(value, strong=True)) or (len(pieces) > 1 and ISSUED.fullmatch(value)):
                add(pieces[0][0], pieces[-1][1], "assigned_value", pieces)
                at = pieces[-1][1]
        for m in ENV.finditer(text):
            v = m.group("v").rstrip(",;")
            if sensitive(m.group("k")) and credential_like(v, strong=True) and (language in ("bash", "yaml", "markdown", "text", None, "unknown") or m.group().lstrip()[:1] in "#;/*"):
                add(m.start("v"), m.start("v") + len(v), "assigned_value")
    for rx, kind, some in ((FLAG, "command_value", FLAG_SIGNS), (PROSE, "note", PROSE_SIGNS), (PROSE_BARE, "note", PROSE_SIGNS)):
        for m in rx.finditer(text) if any(t in low for t in some) else ():
            g = m.lastindex
            v = m.group(g).rstrip(".,;)")
            if credential_like(v, strong=True) and (rx is FLAG or re.search(r"\d", v)):
                add(m.start(g), m.start(g) + len(v), kind)


def find_secrets(text: str | None, language: str | None = None, path: str | None = None) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """``(start, stop, kind, pieces)`` of each credential; ``pieces`` are the spans to redact."""
    if not text:
        return []
    found: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    if "PRIVATE KEY" in text:
        for m in BLOCK.finditer(text):
            end = BLOCK_END.search(text, m.end())
            body_end = end.start() if end else len(text)
            spans = [(m.end() + x.start(), m.end() + x.end()) for x in re.finditer(r"[A-Za-z0-9+/=]{8,}", text[m.end() : body_end])]
            if any(b - a >= 16 for a, b in spans):
                found.append((m.start(), end.end() if end else body_end, "private_key", spans))

    def add(a: int, b: int, kind: str, pieces=None):
        found.append((a, b, kind, pieces or [(a, b)]))

    form = form_of(path, language)
    if form:
        for keys, a, b in _FORMS[form](text):
            if sensitive_path(keys) and credential_like(text[a:b], strong=True):
                add(a, b, "config_value")
    _scan(text, language, add)
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def redact(text: str | None, language: str | None = None, path: str | None = None) -> tuple[str | None, int]:
    """The text with each credential's characters replaced in place, and the number of credentials."""
    found = find_secrets(text, language, path)
    if not found:
        return text, 0
    out, last = [], 0
    for a, b in sorted({p for f in found for p in f[3]}):
        if a >= last:
            out += [text[last:a], MARK]
            last = b
    return "".join(out) + text[last:], len(found)


_FOUND = "array<struct<kind: string, start: int, stop: int, line_no: int>>"


def _located(text: str | None, language: str | None, path: str | None) -> list[tuple[str, int, int, int]]:
    """``(kind, start, stop, line_no)`` with offsets in the text's UTF-8 bytes."""
    found = find_secrets(text, language, path)
    at = (lambda i: i) if not found or text.isascii() else (lambda i: len(text[:i].encode("utf-8", "surrogatepass")))
    return [(f[2], at(f[0]), at(f[1]), 1 + text.count("\n", 0, f[0])) for f in found]


def secrets_in(records: DataFrame) -> DataFrame:
    """``ord, kind, start, stop, line_no`` of every credential; ``start`` and ``stop`` count bytes."""

    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series, langs: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([_located(t, g, p) for t, g, p in zip(texts, langs, paths, strict=True)], dtype=object)

    lang = canonical_language(F.col("language"), F.col("path"))
    r = spread(records.select("ord", "text", "path", lang.alias("lang")))
    return r.select("ord", F.explode(scan("text", "lang", "path")).alias("s")).select("ord", "s.*")


def secret_lines(records: DataFrame) -> DataFrame:
    """``ord, line_no``: lines on which a credential begins."""
    return secrets_in(records).select("ord", "line_no").distinct()


def redact_records(records: DataFrame) -> DataFrame:
    """``ord, text, secrets_redacted`` of the records that hold credentials."""

    @F.pandas_udf("text string, n int")
    def clean(texts: pd.Series, langs: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact(t, g, p) for t, g, p in zip(texts, langs, paths, strict=True)], columns=["text", "n"])

    lang = canonical_language(F.col("language"), F.col("path"))
    r = spread(records.select("ord", "text", "path", lang.alias("lang")))
    return r.select("ord", clean("text", "lang", "path").alias("c")).where("c.n > 0").select("ord", "c.text", F.col("c.n").alias("secrets_redacted"))
