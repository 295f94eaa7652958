"""Secret scan: fixed patterns, and strings that a dictionary-primed compressor finds novel.

Base kinds (``KINDS``) are found by pattern in the whole text.  The method adds spans of
kind ``novel``: a run of 16 or more key-like characters, of at least two character classes,
with a digit or with many changes of case, within ``CONTEXT`` characters after a sensitive word and outside every base span, whose
marginal size is high.  The marginal size is what zstandard needs for dictionary-primed
surroundings with the candidate, less what it needs without: identifiers, paths and words
cost little next to code that holds them, random strings nearly their entropy.  Other copies of the
candidate are taken out of the surroundings first, so a key that stands twice is reported at both places.

A run of key-like characters is measured once, so the scan takes time in proportion to the text.

Defined results: a null or empty text has no spans; rows are scanned one by one, so repeated
rows and ids do no harm; offsets are code points, ends exclusive, of the text as it is; columns other than
the id and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, worker_cache

#: Fixed patterns of the base kinds, in their order.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Words that make what follows sensitive; how far they reach; compressed bytes for each character from which a string is novel.
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|authorization|signature|client[_-]?id|sshkey", re.IGNORECASE | re.ASCII)
LEAST = 16
CANDIDATE, RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST}}}"), re.compile(r"[A-Za-z0-9+/_=-]*")
CONTEXT, AROUND, NOVEL = 48, 256, 0.55
#: Code words, identifiers and common strings that prime the compressor (raw content, most common last).
DICTIONARY = " ".join(
    """abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000000000000000 xxxxxxxxxxxxxxxx
    example placeholder changeme your_api_key_here your-secret-key INSERT_TOKEN_HERE test_password default_value
    import from class public private static final void return function const string integer boolean undefined null
    true false self this super async await export default require module include define struct typedef namespace
    getElementById addEventListener createElement querySelector configuration environment development production
    application/json Content-Type text/html charset=utf-8 https://www.github.com/ http://localhost:8080/api/v1/
    /usr/local/bin /home/user/.ssh/id_rsa /etc/config settings.properties config.yaml docker-compose Dockerfile
    get_secret_value access_token refresh_token client_secret client_id private_key public_key api_key secret_key
    password_hash password_reset authentication authorization credentials certificate signature session_id user_id
    database username hostname endpoint request response connection timeout token_type expires_in password=""".split()
)


def _dictionary():
    return zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Novelty:
    def __init__(self) -> None:
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=_dictionary(), write_content_size=False, write_checksum=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def marginal(self, before: str, candidate: str, after: str) -> int:
        """Compressed bytes that the candidate adds to its surroundings."""
        return self.size(f"{before}{after}{candidate}") - self.size(f"{before}{after}")


def _classes(text: str) -> int:
    return any(c.isdigit() for c in text) + any(c.islower() for c in text) + any(c.isupper() for c in text) + any(not c.isalnum() for c in text)


def _keylike(text: str) -> bool:
    """A digit, or a change of case at a third of the places: names in camel case change it less often, and measured bytes do not tell them from keys."""
    return any(c.isdigit() for c in text) or 3 * sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(text, text[1:])) >= len(text) - 1


def _surroundings(text: str, a: int, z: int) -> tuple[str, str, str]:
    """What stands before a candidate, the candidate, and what stands after it, without its other copies, also those that the edge of the surroundings cuts."""
    own, n = text[a:z], z - a
    before, after = text[max(0, a - AROUND - n) : a].replace(own, ""), text[z : z + AROUND + n].replace(own, "")
    return before[-AROUND:], own, after[:AROUND]


def find_secrets(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = _merged(spans)
    begins = [a for a, _ in base]
    done = 0  # where the last candidate ended: a run of key characters is measured once, from its first place after a sensitive word
    for word in SENSITIVE.finditer(text):
        line_end = text.find("\n", word.end(), word.end() + CONTEXT)
        reach = line_end if line_end >= 0 else word.end() + CONTEXT
        at = max(word.end(), done)
        while at <= reach and (m := CANDIDATE.search(text, at, reach + LEAST)):
            a, z = m.start(), RUN.match(text, m.end()).end()
            at = done = z
            k = bisect_left(begins, z) - 1
            if k >= 0 and base[k][1] > a:
                continue
            if _classes(text[a:z]) >= 2 and _keylike(text[a:z]) and novelty.marginal(*_surroundings(text, a, z)) >= NOVEL * (z - a):
                spans.append(("novel", a, z))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The places that spans cover, in order, none overlapping another."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((a, z) for _, a, z in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _scan(batches):
    novelty = worker_cache(("novelty",), Novelty)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(batches):
        found = [[{"kind": k, "start": a, "end": z} for k, a, z in find_secrets(t, novelty)] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "secrets"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``secrets``, an array of (kind, start, end) ordered by start, then kind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, "doc_id long, secrets array<struct<kind:string,start:int,end:int>>")
