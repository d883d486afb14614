"""Secret scan by token efficiency.

Natural words cost a byte-pair vocabulary few tokens: many characters share one
token.  Random strings don't.  A candidate run of key characters whose ratio of
characters to tokens is low is reported as a span of kind `rare`, unless it is a
known digest or an identifier.  Random letters before a few digits have the look of an
identifier, too: one without separators is taken for such only above JOINED_RATIO.  What has the look of a digest is taken for one, unless
it is the value given to a name for a secret.  Of a run that is not reported, each part
between separators that is long enough is judged by itself, as wordy text joined to a
random string raises the ratio of both.  The three fixed patterns of the base come first
and always stay.

Cases: a null or empty text has no spans; repeated rows are scanned each for
themselves; texts are scanned whole, however long; columns other than the id and
the text are not read, so their names can't clash; an empty table gives an empty
result.  Spans are code points, end exclusive, ordered by start and then kind.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from . import _core

KINDS = ("assign", "access", "hex", "rare")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be matched first
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})=*")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)(?:[_/+=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*[_/+=-]*")
#: A prefilter of ASSIGN: one of these is in every match, in lower case.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

MAX_RATIO, JOINED_RATIO = 2.2, 1.6
VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tiktoken vocabulary at `path`, loaded once a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(s: str, path: str, max_ratio: float, named: bool = False) -> bool:
    """Whether a candidate mixes letters and digits, is no known digest (unless a name for a
    secret stands before it) or identifier, and has at most max_ratio characters for each token
    (JOINED_RATIO, if it could be an identifier without separators)."""
    if s.isalpha() or s.isdigit() or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
        return False
    if not named and DIGEST.fullmatch(s) or UUID.fullmatch(s):
        return False
    if IDENTIFIER.fullmatch(s):
        if not s.isalnum():
            return False
        max_ratio = min(max_ratio, JOINED_RATIO)
    return len(s) <= max_ratio * len(encoder(path).encode_ordinary(s))


def find(text: str, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, place in KINDS, end), ordered."""
    spans, values = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        found = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 0, m.end()) for m in found]
        values = [m.start(2) for m in found]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        k = bisect_left(values, m.start())
        named = k < len(values) and values[k] < m.end()  # a value begins in it
        found = [m] if is_random(m[0], path, max_ratio, named) else [p for p in PART.finditer(text, *m.span()) if p[0] != m[0] and is_random(p[0], path, max_ratio)]
        spans += [(p.start(), 3, p.end()) for p in found]
    return sorted(spans)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """Per row: id, counts of each kind, base_spans and spans as text. `vocabulary`
    is the path of a tiktoken rank file present on every machine."""

    def make():
        def work(cols, texts):
            out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_rare", "base_spans", "spans")}
            out["doc_id"] = cols[0]
            for t in texts:
                spans = find(t.decode("utf-8", "replace"), vocabulary, max_ratio) if t else []
                for i, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(k == i for _, k, _ in spans))
                out["base_spans"].append(shown([s for s in spans if s[1] < 3]))
                out["spans"].append(shown(spans))
            return out

        return work

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, n_rare long, base_spans string, spans string"
    return _core.map_texts(docs, make, ddl, (id_col,), text_col)


def redact(text: str, spans: str, mark: str = "[secret]") -> str:
    """The text with its spans (as `scan` gives them) replaced, overlapping ones together."""
    out, at = [], 0
    places = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b in places:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    found = scan(_core.read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_rare")
