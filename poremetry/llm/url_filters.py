"""URL filters: many wildcard rules at once with a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poremetry.llm.common import ascii_lower, map_texts

# Fixed values: (verdict, rule): host and path in one; a rule fits its host and all subdomains if the path starts with the rule's.
BASE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
# Own rules, for urls that no base rule fits: '?' is any character but '/', '*' any run without '/', '**' any run.
OWN_GLOBS = ["*.ads*.**", "*.ads-track.**", "*.adserver.**", "*.doubleclick.**", "*.cheap-*.**", "*.casino*.**", "*.porn*.**", "*.xxx/**",
             "*.free-download*.**", "**/wp-login.php", "**/phishing/**", "**/adclick/**"]

SLASH, END = ord("/"), 0x00


class GlobAutomaton:
    """Shift-And over all rules together: one bit per pattern character, packed into 64-bit words.

    A state bit means that the pattern characters up to it have been read. Each byte shifts all states by one, keeps those
    whose character fits, and lets the states of a wildcard stay where they are. All urls of a batch advance together.
    """

    def __init__(self, globs: list[str]):
        firsts, lasts, fits, stays, skips = [], [], [], [], []
        for glob in globs:
            firsts.append(len(fits))
            i = 0
            raw = glob.encode()
            while i < len(raw):
                if raw[i:i + 2] == b"**" or raw[i:i + 1] == b"*":
                    deep = raw[i:i + 2] == b"**"
                    allowed = np.ones(256, bool)
                    allowed[SLASH] = deep
                    fits.append(allowed)
                    stays.append(allowed)
                    skips.append(True)
                    i += 2 if deep else 1
                else:
                    allowed = np.zeros(256, bool)
                    allowed[:] = (np.arange(256) != SLASH) if raw[i:i + 1] == b"?" else (np.arange(256) == raw[i])
                    fits.append(allowed)
                    stays.append(np.zeros(256, bool))
                    skips.append(False)
                    i += 1
            fits.append(np.arange(256) == END)  # the end of the url
            stays.append(np.zeros(256, bool))
            skips.append(False)
            lasts.append(len(fits) - 1)
        self.words = (len(fits) + 63) // 64
        self.fit, self.stay = self._pack(np.array(fits).T), self._pack(np.array(stays).T)
        self.first = self._pack(self._bits(firsts))
        self.skip = self._pack(np.array(skips)[None])[0]
        self.lasts = np.array(lasts)

    def _bits(self, places: list[int]) -> np.ndarray:
        row = np.zeros((1, 64 * self.words), bool)
        row[0, places] = True
        return row

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), 64 * self.words), bool)
        wide[:, :bits.shape[1]] = bits
        return np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little")).view("<u8").astype(np.uint64)

    @staticmethod
    def _shift(state: np.ndarray) -> np.ndarray:
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Row per text, column per rule: whether the rule fits the whole text. Texts of similar length advance together."""
        out = np.zeros((len(texts), len(self.lasts)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and stop - start < 4096 and len(texts[order[stop]]) <= 2 * len(texts[order[start]]) + 64:
                stop += 1
            rows = order[start:stop]
            out[rows] = self._run([texts[i] for i in rows])
            start = stop
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        wide = int(lengths.max()) + 1
        # A zero byte inside a url is no end: it is read as 0xFF, which UTF-8 never has.
        grid = np.frombuffer(b"".join(t.replace(b"\0", b"\xff").ljust(wide, b"\0") for t in texts), np.uint8).reshape(len(texts), wide)
        state = np.zeros((len(texts), self.words), np.uint64)
        final = np.zeros_like(state)
        open_at = np.broadcast_to(self.first, state.shape)
        for at in range(wide):
            entering = (self._shift(state) & ~self.first) | (open_at if at == 0 else np.uint64(0))
            while True:  # an empty run: what may enter a wildcard may enter the character after it
                more = entering | (self._shift(entering & self.skip) & ~self.first)
                if (more == entering).all():
                    break
                entering = more
            byte = grid[:, at]
            new = (entering & self.fit[byte]) | (state & self.stay[byte])
            done = lengths == at
            final[done] = new[done]
            # a wildcard that stays may be left at once
            state = new
        bits = np.unpackbits(final.view(np.uint8), axis=1, bitorder="little").astype(bool)
        return bits[:, self.lasts]


def _glob(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"*.{host}/{path}**"


def rule_matcher(base: list[tuple[str, str]], own: list[str]):
    """A function over Arrow batches (page_id, host, path) that adds the longest base rule and the verdict."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = sorted(range(len(base)), key=lambda i: -len(base[i][1]))
        automaton = GlobAutomaton([_glob(base[i][1]) for i in longest] + own)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            texts = [f".{h}{p}".encode() for h, p in zip(hosts, paths)]
            fits = automaton.matches(texts) if texts else np.zeros((0, len(base) + len(own)), bool)
            rules, verdicts = [], []
            for row in fits:
                hit = next((longest[i] for i in np.flatnonzero(row[:len(base)])), None)
                rules.append(None if hit is None else base[hit][1])
                verdicts.append(base[hit][0] if hit is not None else "block" if row[len(base):].any() else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return match


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.when(rest != "", ascii_lower(host)).otherwise(""), F.when(rest != "", path).otherwise("")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", base: list[tuple[str, str]] = BASE_RULES,
          own: list[str] = OWN_GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``, without a shuffle; only the two columns are read.

    The longest fitting base rule decides; a url that none fits is blocked if an own rule matches host and path, else allowed. Null urls
    and urls without ``://`` have empty host and path, no rule, and are allowed. Rows may repeat; an empty table gives an
    empty result; further columns are ignored.
    """
    host, path = canonical(F.col(url))
    kind = pages.schema[page_id].dataType.simpleString()
    return map_texts(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), rule_matcher(base, own), f"page_id {kind}, host string, path string, rule string, verdict string")
