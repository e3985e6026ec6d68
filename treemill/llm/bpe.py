"""BPE encoding and decoding by a prefix-sharing trie traversal.

A text is cut into pretokens (the vocabulary's own pattern); the distinct pretokens of a batch are
taken in byte order, which is the depth-first order of their trie.  The traversal keeps, for
each prefix on the current path, the last token of the prefix's encoding.  The last token
of a longer prefix is the suffix token that stays apart from the last token before it
when the two are merged alone; BPE encodings are consistent in this pairwise way, so one such
suffix exists.  Common prefixes of words are thus encoded once, and walking back along the
path gives a word's whole encoding.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

from pyspark.sql import DataFrame, SparkSession

from treemill.llm.common import documents, per_batch, texts

VOCABULARY = "byte_bpe_50k.json"
#: Encoded words that a task keeps: half of them new, half those used before (only speed depends on it).
REMEMBER = 300_000
#: Bytes of text that are encoded at a time.
SLICE = 4 << 20
#: The pattern of the byte-level pretokenizer, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters whose classes all Unicode versions agree on.
COMMON = r"[\x00-\u0557\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20b0\u2100-\u214f\u3000-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, turned round."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.content = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.find = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.path, self.library = path, None
        self.common = re.compile(COMMON).fullmatch
        self.find_ascii = re.compile(ASCII_PATTERN).findall
        #: by token: for the last token before it, whether the two stay apart
        self.apart: dict[bytes, dict[bytes, bool]] = {t: {} for t in self.ids}
        self.known = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.before: dict[str, bytes] = {}

    def stays_apart(self, left: bytes, token: bytes) -> bool:
        """Whether merging ``left + token`` from its bytes ends in these two tokens; an empty left:
        in the token alone.  The answer is kept in ``apart``.
        """
        found = self.apart[token][left] = self.merged(left + token) == ([left, token] if left else [token])
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short string: the lowest-ranked pair first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def learn(self, words: set[str]) -> None:
        """Puts the encodings of ``words`` into ``known``: one walk over their trie."""
        path, before = [b""], b""
        longest, apart, ids = self.longest, self.apart, self.ids
        for word, text in sorted((w.encode(), w) for w in words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = word[start:end]
                    lefts = apart.get(token)
                    if lefts is None:
                        continue
                    left = path[start]
                    ok = lefts.get(left)
                    if ok or (ok is None and self.stays_apart(left, token)):
                        path.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            before, end, tokens = word, len(word), []
            while end:
                token = path[end]
                tokens.append(ids[token])
                end -= len(token)
            tokens.reverse()
            self.known[text] = array("I", tokens).tobytes()

    def pretokens(self, text: str) -> list[str]:
        """The pretokens of a text; a special token's string is one."""
        if not self.special or not any(t in text for t in self.special):
            return self.cut(text)
        return [w for n, part in enumerate(self.parts(text)) for w in ([part] if n % 2 else self.cut(part))]

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.find_ascii(text)
        if self.common(text):
            return self.find(text)
        # letters and digits of later Unicode versions: as the library's own tables have them
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        cut = list(map(self.pretokens, texts))
        words = set().union(*cut)
        if len(self.known) + len(words) > REMEMBER // 2:
            self.known, self.before = {t: i.to_bytes(4, "little") for t, i in self.special.items()}, self.known
        new = words.difference(self.known)
        again = new.intersection(self.before)
        self.known.update(zip(again, map(self.before.__getitem__, again), strict=True))
        self.learn(new - again)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decoded(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the decoded text; bytes that are no UTF-8 are replaced."""
        data = b"".join(map(self.content.__getitem__, array("I", ids)))
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a file, kept by each worker process from task to task."""
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and decoded text of each row.

    A null text counts as empty: no tokens.  Special tokens' strings in a text become their ids,
    as the vocabulary's library does.  Other columns are not looked at.
    """
    name = path or vocabulary_path()

    def many(own: Codec, rows):
        found = own.encode([text or "" for _, text in rows])
        return [(doc_id, len(ids) // 4, ids, own.decoded(ids).decode()) for (doc_id, _), ids in zip(rows, found, strict=True)]

    return per_batch(texts(docs), many, "doc_id long, n_tokens long, ids binary, decoded string", lambda: codec(name), SLICE)


def encoded_digests(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """``encoded`` with SHA-256 digests in place of the decoded text and, unless asked for, ids."""
    name = path or vocabulary_path()

    def many(own: Codec, rows):
        sha = lambda data: hashlib.sha256(data).hexdigest()
        found = own.encode([text or "" for _, text in rows])
        return [(doc_id, len(x) // 4, sha(x), sha(own.decoded(x)), *([x] if ids else [])) for (doc_id, _), x in zip(rows, found, strict=True)]

    return per_batch(texts(docs), many, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids, lambda: codec(name), SLICE)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir))
