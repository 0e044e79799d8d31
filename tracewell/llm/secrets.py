"""Credentials in source code, configuration, commands and prose (problem 1).

One pass over a text. An automaton of fixed strings finds the anchors: words of which names of credentials are made, first
characters of known forms, URLs, schemes, commands and key blocks. At an anchor the tokens around it are read: the whole
identifier (with a subscript or a closing quote), what sets, calls, follows or pairs it with a value, and the literal or
literals there, with prefixes, escapes, triple quotes, wrappers, lists and pieces joined by operators. A literal is a
credential if its form says so, or if its name does and it isn't a placeholder, a masked value or a reference to a
variable or vault. Only the contents of literals are reported and redacted (all pieces of a secret written in pieces);
delimiters, escapes and names stay. As every rule starts at an anchor, no other test decides which texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.runtime import spread

# What a name may be made of, by how much it says. Parts are in lower case.
_strong = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "token", "apikey", "pass", "pw", "psw", "kennwort", "passwort", "contraseña", "contrasena", "clave", "geheimnis", "secreto", "authtoken", "accesskey", "secretkey", "privatekey", "credential", "credentials", "pin"}
_words_of_passing = {"password", "passwd", "pwd", "passphrase", "passcode", "secret", "kennwort", "passwort", "contraseña", "contrasena", "geheimnis", "secreto"}
_key_of = {"api", "access", "secret", "private", "signing", "sign", "encryption", "encrypt", "auth", "account", "service", "master", "shared", "storage", "deploy", "app", "client", "session", "crypt", "hmac", "jwt", "aes", "license"}
_weak = {"key", "auth", "sig", "signature", "authorization", "cookie", "bearer", "pat", "schlüssel", "schluessel", "llave", "access"}
_ends = ("password", "passwort", "secret", "token", "passphrase", "apikey", *(f"{x}key" for x in sorted(_key_of)))  # also as the end of a longer word
#: Last parts by which a name speaks of something else than the credential, and first ones that say so of a key or token.
_about = {"count", "max", "min", "limit", "total", "public", "pub", "name", "type", "path", "file", "url", "uri", "policy", "length", "size", "hash", "fingerprint", "ttl", "expires", "expiry", "num", "usage", "used", "budget", "age", "prefix", "ref", "version", "sha256", "checksum", "id", "ids", "hashed"}
_other = {"public", "pub", "publishable", "primary", "foreign", "max", "min", "total", "count", "num", "limit", "used", "usage", "budget", "hash", "hashed"}
_holder = {"field", "column", "input", "box", "param", "parameter", "arg", "hint", "env"}
_plural = {"passwords", "passwds", "passphrases", "secrets", "tokens", "keys", "apikeys", "credentials", "pins"}

_quote = r"(?:\\{0,3}[\"'`])"
_known = re.compile(
    r"(?<![A-Za-z0-9_\-/+])(?:"
    r"sk-[A-Za-z0-9_\-]{16,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_\-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_\-]{30,}|gsk_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{20,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]*)?)"
)
_block = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_block_end = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_userinfo = re.compile(r"(?<=[A-Za-z0-9])://(?:([^\s/:@\"'<>\\]*):)?([^\s/@\"'<>\\]{3,})@")
_scheme = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9+/=_.~\-]{8,})")
_client = re.compile(r"(?<![\w\-])(?:mysql|mysqldump|mariadb|sshpass|psql|mongo|redis-cli)\b[^\n|;&]*?\s(?:-p|-a )(?P<v>[^\s\"'\\]{4,})")
_keygen = re.compile(r"ssh-keygen\b[^\n]*?\s-[NP]\s+(?=\\{0,3}[\"'])")
_user = re.compile(r"(?<![\w\-])(?:-u|--user)\s+[\"']?[\w.\-]+:(?P<v>[^\s\"'\\]{4,})")
_identified = re.compile(r"(?i:identified by)\s+(?=\\{0,3}[\"'])")
_prose = re.compile(
    r"(?<!\w)(?:password|passphrase|passcode|secret|token|key|credentials?|login|pin|kennwort|passwort|schlüssel|contraseña|clave)\b"
    r"(?:\s+(?:for|to|of|on|in|at|für|von|auf|de|del|para)\s+(?:the\s+|der\s+|den\s+|la\s+|el\s+)?`?[\w.\-]+`?){0,2}"
    r"(?:\s+(?:is|was|ist|war|lautet|es|era)\s+(?:now\s+|still\s+|jetzt\s+|ahora\s+)?|\s*:\s+)(?=[`\"'\\]|\S)",
    re.I,
)
_follow = re.compile(r"(?<![\w\-.])(?:password|passwd|passphrase|(?:pass|pw|PASSWORD)(?=\s+\\{0,3}[\"'`])|[A-Z][A-Z0-9_]*_(?:TOKEN|KEY|SECRET|PASSWORD|PASSWD|PASS|PWD|PASSPHRASE))[ \t]+(?=\S)")
_flag = re.compile(r"(?<![\w\-])--?[a-z][a-z\-]*[= ]\s*")
#: What stands between a name and its value: the rest of a subscript or quote, a type, and an operator.
_set = re.compile(
    _quote + r"?\s*[\])]{0,2}\s*(?::\s*(?:(?:typing\.)?Optional\[)?(?:str|string|String|bytes|SecretStr|Secret)\]?(?:\s*\|\s*None)?(?=\s*=[^=]))?\s*"
    r"(?P<op>:=|:-|=>|->|\|\|=?|\?\?=?|[?+]=|={1,3}|:(?!//)|or(?=\s+" + _quote + r")|>(?=[^\s<]))\s*"
)
_lead = re.compile(r"(?:!!?[\w:/.\-]+[ \t]+|\(\s*|[|>][+\-]?[ \t]*\n\s*)*(?:[rbfuRBFU@]{1,2}(?=\\{0,3}[\"']))?")
_wrapper = re.compile(r"(?:new\s+)?(?P<f>[A-Za-z_][\w.:]*)\(\s*(?:[rbfuRBFU]{1,2}(?=\\{0,3}[\"']))?(?=\\{0,3}[\"'`])")
_wrappers = {"string", "str", "secretstr", "secret", "secretstring", "securestring", "bytes", "bytearray", "from", "fromstring", "decode", "encode", "b64decode", "b64encode", "quote", "password", "token", "credential", "azurekeycredential", "apikey", "raw", "literal", "value", "strdup", "of", "wrap", "plaintext"}
_list = re.compile(r"(?:\[|\{|\(|(?:Arrays\.asList|List\.of|Set\.of|listOf|setOf|array)\()\s*(?=\\{0,3}[\"'`])")
_comma = re.compile(r"\s*,\s*(?:[rbfuRBFU]{1,2}(?=[\"']))?(?=\\{0,3}[\"'`])")
_join = re.compile(r"(?:\s*(?:\+|\.\.?|&|\\\s*\n)\s*|[ \t]+)(?:[rbfuRBFU]{1,2}(?=[\"']))?(?=\\{0,3}[\"'`])")
_join_in = re.compile(r"\s*(?:\+|\.\.?|&|\\\s*\n)?\s*(?:[rbfuRBFU]{1,2}(?=[\"']))?(?=\\{0,3}[\"'`])")  # within parentheses
_key_end = re.compile(r"\s*[:=]")
_call = re.compile(r"\(\s*(?:[rbfu]{1,2}(?=[\"']))?(?=\\{0,3}[\"'`])")
_default = re.compile(_quote + r"\s*,\s*(?:[rbfuRBFU]{1,2}(?=[\"']))?(?=\\{0,3}[\"'`])")
_pair = re.compile(r"(?:" + _quote + r"\s*,?|\s*\n|</(?:name|key)>)\s*(?:" + _quote + r"|<)?(?:value|val)(?:" + _quote + r")?\s*[:=>]\s*(?=\S)")
_titled = re.compile(r"(?:name|key|field|variable|setting)\\{0,3}[\"'`]?\s*[:=>]\s*\\{0,3}[\"'`]?$")
_open = re.compile(r"(\\{0,3})(\"\"\"|'''|[\"'`])")
_bare_stop = re.compile(r"[\s\"'`;,&<>|)\]}]|\\")
_escaped = re.compile(r"\\+[nrt]")
_marks = re.compile(r"\\+u(?:[eE][0-9a-fA-F]|[fF][0-8]|200[b-fB-F]|[fF][eE][fF][fF])[0-9a-fA-F]{0,2}|[\ue000-\uf8ff\u200b-\u200f\ufeff]")
_split = re.compile(r"[A-ZÀ-Þ]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿß]+|\d+")
_rest = re.compile(r"[\w.$\-]*")
_code = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*[\[(]|[A-Za-z_]+(?:\.[A-Za-z_]+)+$")
_special = re.compile(r"[\d#$%!@*~^&+=_\-]")

_reference = re.compile(r"^(?:\$[\w{(]|%\w+%|\{\{|<|(?:vault|arn|ssm|op|gcp|awssm|sops|file|env|keyring|ref|secretref)[:+]|kv/|None$|null$|nil$|undefined$|true$|false$)", re.I)
_bare_reference = re.compile(r"^(?:\$|@|process\.env|os\.|env[.(\[]|getenv|System\.|ENV\[|vault[.:(]|var\.|secrets?\.|self\.|config\.|settings\.|ref\b|data\.|file\(|read|lookup|keyring|!{1,2}\w|None\b|null\b|nil\b|undefined\b|true\b|false\b|string\b|str\b)", re.I)
_mask = re.compile(r"^(?:[*xX•.\-_#?0]+|\[?REDACTED.*|<.*>|.*\*{3,}.*)$", re.I)
#: Words of which stand-ins are made, and those of them that begin one whatever words follow.
_stand_in = set(
    "your my insert enter change changeme replace replaceme put some the a an example sample dummy fake test testing todo tbd none null hidden masked removed placeholder secret "
    "password passwd pwd token key api unset empty optional required default redacted here value goes me this with from in of to set user name id real actual own foo bar env vault "
    "see not stored is be string str text xxx xxxx".split()
)
_begins = set("your my insert enter change replace put some example sample dummy fake todo tbd hidden masked removed placeholder unset redacted the optional required".split())


@lru_cache(1 << 14)
def kind_of(name: str) -> int:
    """2 for a name that says credential, 1 for one that may, 0 for others; the last parts decide."""
    parts = [p.lower() for p in _split.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return 0
    last, joined = parts[-1], "".join(parts)
    if last in _about:
        return 0
    if last in _words_of_passing or joined in _strong or joined.endswith(("password", "passwort", "passphrase")):
        return 0 if "hashed" in parts else 2
    if _other.intersection(parts):
        return 0
    if last in _holder:
        return int(len(parts) > 1 and parts[-2] in _strong)
    if any(p in _strong for p in parts[-2:]) or joined.endswith(_ends):
        return 2
    if last == "key" and len(parts) > 1 and _key_of.intersection(parts[:-1]):
        return 2
    return int(last in _weak or "key" in parts)


def random_looking(v: str) -> bool:
    """Whether ``v`` is long and mixed enough to be generated."""
    if len(v) < 12 or " " in v:
        return False
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", r"\d"))
    return kinds >= 2 and len(set(v)) >= 8


def telling(v: str) -> bool:
    """Whether ``v``, beside a name only, reads like a secret: without spaces, and digits or signs among letters."""
    return len(v) >= 6 and " " not in v and not v.startswith(("http://", "https://", "/")) and bool(re.search(r"[^\W\d_]", v)) and bool(re.search(r"\d|[#$%!@*~^&+=]|[a-z][A-Z]", v))


def placeholder(v: str, quoted: bool = True) -> bool:
    """Whether a literal stands for no credential: empty, masked, a stand-in or a reference."""
    if len(v) < 4 or len(set(v)) < 3 or _reference.match(v) or _mask.match(v) or "${" in v or "{{" in v or "[REDACTED" in v:
        return True
    if not quoted and _bare_reference.match(v):
        return True
    parts = _split.findall(v)
    said = [p.lower() for p in parts]
    if parts and all(p in _stand_in or p.isdigit() and len(p) < 4 for p in said) and not re.search(r"[#$%!@*~^&+=]", v):
        return True
    return bool(parts) and said[0] in _begins and len(parts) > 1 and all(p.isalpha() and p in (q, q.upper()) for p, q in zip(parts, said, strict=True)) and not re.search(r"[#$%!@*~^&+=]", v)


def literal(text: str, at: int) -> tuple[int, int, bool, int] | None:
    """(start, end, quoted, after) of the literal that begins at ``at``, without its delimiters."""
    m = _open.match(text, at)
    if not m:
        m = _bare_stop.search(text, at)
        end = m.start() if m else len(text)
        return (at, end, False, end) if end > at else None
    close, begin = m.group(), m.end()
    end = begin
    while True:
        end = text.find(close, end)
        if end < 0:
            return None
        back = 0
        while end - back - 1 >= begin and text[end - back - 1] == "\\":
            back += 1
        if close[0] != "\\" and back % 2:  # an escaped delimiter belongs to the literal
            end += 1
            continue
        break
    after = end + len(close)
    if len(m.group(2)) == 3:
        inner = text[begin:end]
        begin += len(inner) - len(inner.lstrip())
        return begin, max(begin, begin + len(inner.strip())), True, after
    if "\n" in text[begin:end] and not text.startswith("-----BEGIN", begin):
        return None
    return begin, end, True, after


def pieces(text: str, at: int, joins: bool = True) -> tuple[list[tuple[int, int]], bool, int] | None:
    """(pieces, quoted, after) of the literal at ``at`` and, with ``joins``, of those joined to it."""
    x = literal(text, at)
    if not x:
        return None
    found, quoted, after = [(x[0], x[1])], x[2], x[3]
    join = _join_in if text[max(0, at - 40) : at].rstrip()[-1:] == "(" else _join
    while joins and quoted and (m := join.match(text, after)) and m.end() > after and (x := literal(text, m.end())) and not _key_end.match(text, x[3]):
        found.append((x[0], x[1]))
        after = x[3]
    return found, quoted, after


def values(text: str, at: int, plural: bool) -> list[tuple[list[tuple[int, int]], bool, int]]:
    """The literals that a name is set to at ``at``: one, or those of a list, or what a wrapper or look-up holds."""
    if m := _list.match(text, at):
        out, x = [], pieces(text, m.end())
        while x:
            out.append(x)
            m2 = _comma.match(text, x[2])
            x = pieces(text, m2.end()) if m2 else None
        if not out or re.match(r"\s*:", text[out[-1][2] : out[-1][2] + 8]):
            return []  # the keys of an object
        return out if plural or len(out) == 1 else []
    at = _lead.match(text, at).end()
    if m := _wrapper.match(text, at):
        x = pieces(text, m.end())
        if m.group("f").split(".")[-1].split(":")[-1].lower() in _wrappers:
            return [x] if x else []
        m2 = x and _comma.match(text, x[2])  # a look-up: its default
        y = pieces(text, m2.end()) if m2 else None
        return [y] if y and telling(text[y[0][0][0] : y[0][0][1]]) else []
    x = pieces(text, at)
    return [x] if x else []


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for tag, words in (
        ("known", "sk- sk_ rk_ ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xox akia asia aiza gsk_ hf_ npm_ sg. eyj".split()),
        ("block", ["-----begin "]),
        ("url", ["://"]),
        ("client", "mysql mariadb sshpass psql mongo redis-cli".split()),
        ("keygen", ["ssh-keygen"]),
        ("user", ["-u", "--user"]),
        ("identified", ["identified by"]),
        ("login", ["login"]),
        ("scheme", ["basic"]),
        ("name", sorted(_strong | _weak)),
    ):
        for w in words:
            a.add_word(w, (tag, len(w)))
    a.make_automaton()
    return a


ANCHORS = _automaton()


def secrets(text: str) -> list[list[tuple[int, int]]]:
    """The credentials in ``text``, in order, none inside another; each a list of (start, end), one for each piece."""
    found: list[list[tuple[int, int]]] = []
    low = text.lower()
    if len(low) != len(text):  # places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = list(ANCHORS.iter(low))
    if not hits:
        return []
    text = _escaped.sub(lambda m: "\n".rjust(len(m.group())), text)  # an escaped line end is one; places stay

    def add(*parts: tuple[int, int]) -> None:
        kept = []
        for start, end in parts:
            # Invisible or escaped marks around a secret aren't part of it.
            while (m := _marks.match(text, start)) and m.end() < end:
                start = m.end()
            if (m := _marks.search(text, start, end)) and m.end() == end:
                end = m.start()
            if end > start:
                kept.append((start, end))
        if kept:
            found.append(kept)

    def whole(x) -> str:
        return "".join(text[s:e] for s, e in x[0])

    read = -1  # end of the identifier that was read last
    for last, (tag, n) in hits:
        at = last + 1 - n
        if tag == "name":
            c = text[last + 1 : last + 2]
            if c.islower() and c != "s" and text[last].islower():
                continue  # inside a longer word
            p = text[at - 1 : at]
            starts = not p.isalpha() or text[at].isupper() and (p.islower() or text[at + 1 : at + 2].islower())
            if n > 4 and (m := _scheme.match(text, at)):
                v = m.group(1)
                if not placeholder(v) and (random_looking(v) or len(v) >= 20) and re.search(r"\d|[A-Z].*[A-Z]|=", v):
                    add(m.span(1))
            if starts and (m := _prose.match(text, at)) and (x := literal(text, m.end())):
                s, e, quoted, _ = x
                v = text[s:e] if quoted else text[s:e].rstrip(".,:")
                if not placeholder(v, quoted) and (re.search(r"\d", v) and re.search(r"[^\W\d]|[#$%!@]", v) or re.search(r"[#$%!@*~^+=]|[a-z]-[a-z]+-|[a-z][A-Z]", v)) and not re.fullmatch(r"[\d.,:%]+|\d+\w{1,2}", v):
                    add((s, s + len(v)))
            if last < read or not (starts or low.endswith(_ends, 0, last + 1)):
                continue
            begin = at
            while begin and ((q := text[begin - 1]).isalnum() or q in "_.$-"):
                begin -= 1
            end = _rest.match(text, last + 1).end()
            read = end
            name = text[begin:end].rstrip(".-")
            end = begin + len(name)
            bare_name = name.lstrip("-.$")
            begin += len(name) - len(bare_name)
            kind = kind_of(bare_name)
            parts = [p.lower() for p in _split.findall(bare_name)]
            plural = bool(parts) and parts[-1] in _plural
            if m := _follow.match(text, begin):
                if (x := pieces(text, m.end(), False)) and not placeholder(v := whole(x), x[1]) and (x[1] or _special.search(v) and v[-1:] != ":" or re.search(r"[a-z][A-Z]", v) and v[-1:] != ":"):
                    add(*x[0])
            if not kind and not plural:
                continue
            if begin and text[begin - 1] == "-" and (m := _flag.match(text, end - len(name))) and m.end() > end:
                op, got = "-", [x for x in [pieces(text, m.end(), False)] if x]
            elif m := _set.match(text, end):
                op, got = m.group("op"), values(text, m.end(), plural or kind == 2)
                if op == ":" and not got and (m2 := _pair.match(text, end)):
                    got = [x for x in [pieces(text, m2.end())] if x]
            elif m := _call.match(text, end):
                op, got = "(", [x for x in [pieces(text, m.end())] if x]
            elif (m := _pair.match(text, end)) and _titled.search(text, max(0, begin - 24), begin):
                op, got = "pair", [x for x in [pieces(text, m.end())] if x]
            elif m := _default.match(text, end):
                op, got = "default", [x for x in [pieces(text, m.end())] if x and telling(whole(x))]
            else:
                continue
            for x in got:
                v, quoted = whole(x), x[1]
                stop = x[0][-1][1]
                if placeholder(v, quoted) or not quoted and (text[stop : stop + 1] in "([" and text[stop : stop + 1] or _code.match(v)):
                    continue
                if (kind < 2 or len(got) > 1 and plural) and not random_looking(v) and not (plural and kind != 1 and telling(v)):
                    continue
                if op == ":" and not quoted and (bare_name.islower() or bare_name.istitle()) and text[x[0][0][0] - 1] in " " and not _special.search(v):
                    continue  # a word of prose after a colon
                if not quoted and (" " in v or op in ("(", "pair") and not telling(v)) or v.startswith(("http://", "https://")) and kind == 1:
                    continue
                if (m := _scheme.match(text, x[0][0][0])) and m.end() <= stop:
                    continue  # read as a scheme
                add(*x[0])
        elif tag == "known":
            if (m := _known.match(text, at)) and not placeholder(m.group()) and not re.search(r"x{6,}|X{6,}|\*", m.group()):
                add(m.span())
        elif tag == "url":
            if (m := _userinfo.match(text, at)) and not placeholder(m.group(2), False) and (m.group(1) is not None or random_looking(m.group(2))):
                add(m.span(2))
        elif tag == "scheme":
            if (m := _scheme.match(text, at)) and not placeholder(v := m.group(1)) and re.search(r"\d|[A-Z].*[A-Z]|=", v):
                add(m.span(1))
        elif tag == "block":
            if m := _block.match(text, at):
                e = _block_end.search(text, m.end())
                add((at, e.end() if e else len(text)))
        elif tag in ("client", "user"):
            if (m := (_client if tag == "client" else _user).match(text, at)) and not placeholder(m.group("v"), False):
                add(m.span("v"))
        elif tag == "login":
            if (m := _prose.match(text, at)) and (x := literal(text, m.end())) and telling(v := text[x[0] : x[1]].rstrip(".,:")) and not placeholder(v, x[2]):
                add((x[0], x[0] + len(v)))
        elif (m := (_keygen if tag == "keygen" else _identified).match(text, at)) and (x := literal(text, m.end())) and not placeholder(text[x[0] : x[1]]):
            add((x[0], x[1]))
    found.sort(key=lambda p: (p[0][0], -len(p), -p[-1][1]))
    out: list[list[tuple[int, int]]] = []
    for p in found:
        if not out or p[0][0] >= out[-1][-1][1]:
            out.append(p)
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the credentials in ``text``, in order; of one in pieces, of its first piece."""
    return [p[0] for p in secrets(text)]


def redact(text: str | None) -> str | None:
    """``text`` with the contents of credentials replaced, each piece; delimiters, escapes and names stay."""
    if text is None:
        return None
    out, at = [], 0
    for p in secrets(text):
        for s, e in p:
            out += [text[at:s], "[REDACTED]"]
            at = e
    return "".join([*out, text[at:]])


def step_texts(traces: DataFrame) -> DataFrame:
    """(trace_id, step_pos, call_pos, field, text) of all contents, args and results that aren't null or empty."""
    steps = spread(traces.select("id", "steps")).where(F.col("id").isNotNull()).select(F.col("id").alias("trace_id"), F.posexplode(F.transform("steps", lambda s: F.struct(s["content"].alias("content"), F.transform(s["tool_calls"], lambda c: F.struct(c["args"].alias("args"), c["result"].alias("result"))).alias("calls")))).alias("step_pos", "s"))
    part = lambda at, field, text: F.struct(at.alias("call_pos"), F.lit(field).alias("field"), text.alias("text"))
    content = F.array(part(F.lit(-1), "content", F.col("s.content")))
    calls = F.flatten(F.transform("s.calls", lambda c, i: F.array(part(i, "args", c["args"]), part(i, "result", c["result"]))))
    every = F.concat(content, F.coalesce(calls, F.slice(content, 1, 0)))
    return steps.select("trace_id", "step_pos", F.inline(F.filter(every, lambda x: x["text"] != "")))


def credentials(traces: DataFrame) -> DataFrame:
    """(trace_id, step_pos, call_pos, field, start_pos, length): a row per credential; call_pos is -1 for content.

    ``traces``: id, steps. Null or empty texts, null steps, calls and ids are no cases; a trace delivered twice counts
    once; positions count characters of the stored string from 0; an empty table gives an empty result. The texts are
    read where they lie; only the findings are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, starts, lengths = [], [], []
            for i, t in enumerate(b.column(4).to_pylist()):
                for s, e in spans(t):
                    take.append(i)
                    starts.append(s)
                    lengths.append(e - s)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["trace_id", "step_pos", "call_pos", "field", "start_pos", "length"])

    return step_texts(traces).mapInArrow(run, "trace_id string, step_pos int, call_pos int, field string, start_pos int, length int").dropDuplicates(["trace_id", "step_pos", "call_pos", "field", "start_pos"])


def redacted(traces: DataFrame) -> DataFrame:
    """(trace_id, step_pos, call_pos, field, text, found): texts that hold a credential, redacted, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, texts, counts = [], [], []
            for i, t in enumerate(b.column(4).to_pylist()):
                if n := len(secrets(t)):
                    take.append(i)
                    texts.append(redact(t))
                    counts.append(n)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["trace_id", "step_pos", "call_pos", "field", "text", "found"])

    return step_texts(traces).mapInArrow(run, "trace_id string, step_pos int, call_pos int, field string, text string, found int").dropDuplicates(["trace_id", "step_pos", "call_pos", "field"])
