"""Problem 3: credentials in source and configuration texts, found by trigram index and verified by regex; redaction."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import reference
from . import trigrams

#: Names that a credential is given under.
NAMES = (
    r"(?:api[ _-]?key|access[ _-]?key|secret[ _-]?key|signing[ _-]?key|account[ _-]?key|encryption[ _-]?key|master[ _-]?key|auth[ _-]?token|private[ _-]?token|client[ _-]?secret|webhook[ _-]?secret"
    r"|token|secret|pass[ _-]?phrase|passw(?:or)?d|passwort|kennwort|mot[ _-]de[ _-]passe|contrase(?:n|ñ)a|pwd|pass)"
)
_JOIN = r"""[ \t]*(?:\+|\\)?[ \t]*\r?\n?[ \t]*(?:\+[ \t]*)?"""
_PIECES = rf"""(?:[rbuf]?"(?:[^"\\\n]|\\.)*"|[rbuf]?'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)(?:{_JOIN}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))*"""
_BARE = r"""[^\s"'`,;&()\[\]{}<>\\]+|\$\{[^}\s]*\}|\{\{[^}\n]*\}\}|<[^>\n]*>"""

#: The rules: name, regex (case ignored) with the value as group v, kind of check for the value.
RULES = {
    "private_key": (r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?P<v>[^-]*(?:-{1,4}[^-]+)*)", "key"),
    "named": (rf"""(?<![a-z0-9]){NAMES}["'`]?[ \t]*(?::[ \t]*(?:[a-z]+[ \t]+|str|string|bytes)=(?!=)|:=|=>|==?|:)[ \t]*(?:\([ \t]*\r?\n?[ \t]*|[>|][+-]?[ \t]*\r?\n[ \t]+|\\\r?\n[ \t]*)?(?P<v>{_PIECES}|{_BARE})""", "value"),
    "camel": (rf"""[a-z0-9](?-i:Password|Passwd|Token|Secret|ApiKey|AccessKey|Pwd)["'`]?[ \t]*(?::=|=>|=|:)[ \t]*(?P<v>{_PIECES}|{_BARE})""", "value"),
    "option": (rf"""--(?:[a-z]+-){{0,2}}{NAMES}(?:["']?,[ \t]*|[ \t]+|=)(?P<v>{_PIECES}|{_BARE})""", "value"),
    "prose": (rf"""(?<![a-z0-9]){NAMES}(?:[ \t]+(?:is|to|of|was|lautet|ist|est))?[ \t]+(?P<v>`[^`\n]+`|"[^"\n]+"|'[^'\n]+'|[^\s"'`,;()<>{{}}\[\]]+)""", "strong"),
    "login": (r"""(?:login|user|account)[ \t]+\S+?[ \t]*/[ \t]*(?P<v>\S+)""", "strong"),
    "url": (r"""[a-z][a-z0-9+.-]{1,20}://[^\s:/@"'<>]*+:(?P<v>[^\s@/"'<>]+)@""", "userinfo"),
    "bearer": (r"""(?:bearer|token)[ \t]+(?P<v>[^\s"'`,;<>]{8,})""", "strong"),
    "basic": (r"""basic[ \t]+(?P<v>[a-z0-9+/_-]{8,}={0,2})""", "basic"),
    "user_option": (r"""(?:curl|wget|http)[^\n]*?[ \t](?:-u|--user)[ \t=]*["']?[^\s:"']++:(?P<v>[^\s"']+)""", "userinfo"),
    "dash_p": (r"""(?:mysql|mariadb|mysqldump|mongo|sshpass|psql|redis-cli)[^\n]*?[ \t]-[pa](?P<v>'[^'\n]+'|"[^"\n]+"|[^\s"'-][^\s"']+)""", "userinfo"),
    "pair": (r"""auth[ \t]*=[ \t]*(?:\w+)?\([ \t]*["'][^"'\n]*["'][ \t]*,[ \t]*(?P<v>"[^"\n]*"|'[^'\n]*')""", "userinfo"),
    "aws": (r"(?<![a-z0-9+/])(?P<v>(?-i:AKIA|ASIA)[A-Z0-9]{16})(?![a-z0-9+/])", "token"),
    "github": (r"(?<![a-z0-9])(?P<v>(?:ghp|gho|ghu|ghs|ghr)_[a-z0-9]{30,}|github_pat_[a-z0-9_]{22,})", "token"),
    "sk": (r"(?<![a-z0-9])(?P<v>sk-ant-[a-z0-9_-]{12,}|sk-proj-[a-z0-9_-]{12,}|(?:sk|rk)_live_[a-z0-9]{12,}|(?:sk|rk)_test_[a-z0-9]{12,})", "token"),
    "other_token": (r"(?<![a-z0-9])(?P<v>xox[abprs]-[a-z0-9-]{10,}|glpat-[a-z0-9_-]{16,}|npm_[a-z0-9]{30,}|(?-i:AIza)[a-z0-9_-]{30,}|hf_[a-z0-9]{30,}|dop_v1_[a-f0-9]{40,})", "token"),
    "jwt": (r"(?<![a-z0-9])(?P<v>(?-i:eyJ)[a-z0-9_-]{8,}\.(?-i:eyJ)[a-z0-9_-]{8,}\.[a-z0-9_-]{10,})", "token"),
}

_PLACEHOLDER = re.compile(
    r"""(?ix) ^(?: [x*.#•_-]{3,} | <.*> | \$\{.*\}? | \{\{.*\}?\}? | \$\(.*\)? | %\w+%? | \$[a-z_]\w* | your[ _-].* | (?:my|an?|the|some)[ _-](?:secret|token|password|key).* | redacted.* | \[?(?:redacted|hidden|masked|removed)\]?
      | change[ _-]?me.* | replace[ _-]?me.* | example.* | placeholder.* | dummy.* | sample.* | todo.* | tbd | null | none | nil | true | false | undefined | secret | password | token | test | foo(?:bar)? | n/?a | str | string | bytes | int )$
      | \.\.\. | … | x{6,} | \*{3,} | (?:^|[./:#])vault[./:#] | ^(?:vault|secrets?|env|ssm|kms|keyring|op)[:/] | secretsmanager | keyvault
      | ^(?:os|process|sys|config|cfg|settings|secrets|vault|args|self|ctx|env|request|params|options|opts|input|getpass|conf)\b[.\[(] | getenv | environ """
)
#: A key that holds a mark like … or **** is masked, unless this many characters in a row of it are there.
_MASK, LEAST_KEY = re.compile(r"\.\.\.|…|x{6,}|\*{3,}", re.IGNORECASE), 40
_REFERENCE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")
_COMPILED = {name: (re.compile(pattern, re.IGNORECASE), kind) for name, (pattern, kind) in RULES.items()}
#: Rules that look for an option anywhere on the line of a command: the command's part.
_COMMANDS = {name: re.compile(pattern.split(r"[^\n]*?")[0], re.IGNORECASE) for name, (pattern, _) in RULES.items() if r")[^\n]*?[ \t]" in pattern}
_LITERAL = re.compile(r"""[rbuf]?"((?:[^"\\\n]|\\.)*)"|[rbuf]?'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`""", re.IGNORECASE)


def _strong(s: str) -> bool:
    """Whether a word of prose looks made up: letters and digits, letters with signs among them, or letters that change case again and again."""
    if len(s) < 8 or re.fullmatch(r"[\w.-]+\.(?:py|sh|json|ya?ml|md|txt|env|prompt)|v?\d[\d.]*\w{0,3}|[a-z_]+_\d{1,3}|\d+-\w+", s, re.IGNORECASE):
        return False
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    return mixed or len(re.findall(r"[a-z][A-Z]", s)) >= 2 or bool(re.search(r"[A-Za-z][~!%$^&*?#@]+[A-Za-z]", s))


def _plain_base64(s: str) -> str | None:
    if len(s) < 8 or len(s) % 4 or not re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", s):
        return None
    try:
        t = base64.b64decode(s.replace("-", "+").replace("_", "/"), validate=True).decode("ascii")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return t if t.isprintable() else None


def holds(raw: str, kind: str) -> bool:
    """Whether the text of a value, with its quotes, is a credential rather than a placeholder, reference, mask or limit."""
    pieces = [next((g for g in m.groups() if g is not None), "") for m in _LITERAL.finditer(raw)] if raw[:1] in "\"'`" or raw[1:2] in "\"'" else []
    quoted, value = bool(pieces), "".join(pieces) if pieces else raw
    value = value.strip().rstrip("," if quoted else ".,;:")
    if kind == "key":
        body = re.sub(r"\\[rn]|[\s#]", "", value.split("-----END")[0])
        return len(body) >= 16 and (not _PLACEHOLDER.search(body) or max(map(len, _MASK.split(body))) >= LEAST_KEY)
    if _PLACEHOLDER.search(value) or len(value) < 6:
        return False
    if kind == "basic":
        t = _plain_base64(value)
        return t is not None and ":" in t and not _PLACEHOLDER.search(t.split(":", 1)[1]) and len(t.split(":", 1)[1]) >= 4
    if (t := _plain_base64(value)) is not None and _PLACEHOLDER.search(t):
        return False
    if kind == "strong":
        return _strong(value)
    if kind == "token":
        return len(set(value)) >= 6
    if kind == "value" and not quoted and _REFERENCE.fullmatch(value) and not any(c.isdigit() for c in value) and (value.islower() or value.isupper() or "." in value):
        return False
    return not re.fullmatch(r"[0-9.,_ -]*|\d+[smhdkKMGB]{0,2}", value) and " " not in value.strip() or (quoted and _strong(value) and value.count(" ") <= 1)


def matches(text: str, name: str) -> Iterator[re.Match]:
    """finditer() of a rule; a line on which a command has no such option is passed over for all further commands on it."""
    pattern, command = _COMPILED[name][0], _COMMANDS.get(name)
    if command is None:
        yield from pattern.finditer(text)
        return
    c = command.search(text)
    while c:
        m = pattern.match(text, c.start())
        if m:
            yield m
        end = m.end() if m else text.find("\n", c.start())
        c = command.search(text, end) if end >= 0 else None


def scan(text: str, rules: list[str]) -> list[tuple[int, int]]:
    """Spans of credential values in a text, by the rules named; sorted, without those inside others."""
    spans = []
    for name in rules:
        kind = _COMPILED[name][1]
        for m in matches(text, name):
            raw = m.group("v")
            if name == "private_key":
                if holds(raw, kind):
                    spans.append((m.start(), m.start("v") + len(raw.split("-----END")[0].rstrip("-")), m.start("v")))
                continue
            if not holds(raw, kind):
                continue
            a, b = m.span("v")
            spans.append((a, b, a))
    return sorted(set(spans))


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the letters and digits of the spans blanked by *; quotes, white space and length stay."""
    out, at = [], 0
    for a, b in sorted(spans):
        a = max(a, at)
        if b > a:
            out += [text[at:a], re.sub(r"[^\s\"'`]", "*", text[a:b])]
            at = b
    return "".join(out) + text[at:]


def files_of(commits: DataFrame) -> DataFrame:
    """(commit_hash, tree, path, fid, text) of the files of each commit; fid is the SHA-256 of the text.

    Null maps and null texts have no files; commits without a hash cannot be named and are left out. A commit stored
    repeatedly has its files repeatedly.
    """
    each = [commits.select(reference(F.col("commit_hash")).alias("commit_hash"), F.lit(t).alias("tree"), F.explode(t).alias("path", "text")) for t in ("prompts", "tools")]
    return each[0].unionByName(each[1]).where("commit_hash is not null and text is not null").withColumn("fid", F.unhex(F.sha2("text", 256)))


def texts_of(files: DataFrame) -> DataFrame:
    """(fid, text): each text once; inherited files and those of repeated commits are scanned once."""
    return files.groupBy("fid", "text").agg(F.lit(1)).select("fid", "text")


def spans_of(texts: list[str], rules: trigrams.Rules) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(text, spans) of the texts with credentials, by their numbers.

    1. Texts are cut into chunks; 2. their trigrams are posted, as far as a rule requires them; 3. per rule the postings
    are intersected to candidate chunks; 4. the regexes run on the texts of candidates only, each on those of its own
    rule, and on whole texts: values and lines may be longer than a chunk.
    """
    found = [(i, scan(texts[i], names)) for i, names in trigrams.candidate_rules(texts, rules)]
    return [(i, spans) for i, spans in found if spans]


def _rules() -> trigrams.Rules:
    return trigrams.Rules({name: pattern for name, (pattern, _) in RULES.items()})


def lines(texts: DataFrame) -> DataFrame:
    """(fid, line_no) of texts (fid, text): the lines on which credentials begin."""
    rules = _rules()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("text").to_pylist()
            found = [(i, n) for i, spans in spans_of(held, rules) for n in sorted({line_of(held[i], a) for a, _, _ in spans})]
            yield pa.RecordBatch.from_arrays([b.column("fid").take(pa.array([i for i, _ in found], pa.int64())), pa.array([n for _, n in found], pa.int64())], ["fid", "line_no"])

    return texts.mapInArrow(search, "fid binary, line_no long")


def places(commits: DataFrame) -> DataFrame:
    """(commit_hash, tree, path, line_no): one row per commit, file and line on which a credential starts."""
    files = files_of(commits)
    return files.drop("text").join(lines(texts_of(files)), "fid").select("commit_hash", "tree", "path", "line_no").distinct()


def redacted(commits: DataFrame) -> DataFrame:
    """(commit_hash, tree, path, text, n_spans): every file, credentials blanked, all else unchanged."""
    files, rules = files_of(commits), _rules()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [0] * len(texts)
            for i, spans in spans_of(texts, rules):
                blanked = sorted({(v, z) for _, z, v in spans})
                texts[i], n[i] = blank(texts[i], blanked), len(blanked)
            yield pa.RecordBatch.from_arrays([b.column("fid"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["fid", "text", "n_spans"])

    clean = texts_of(files).mapInArrow(apply, "fid binary, text string, n_spans long")
    return files.drop("text").distinct().join(clean, "fid").select("commit_hash", "tree", "path", "text", "n_spans")
