"""Language identification by compression: the language whose dictionary shortens a text most."""

from __future__ import annotations

import re
from collections.abc import Callable

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import with_computed

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Compressible padding: without it before a piece zstandard stores short ones raw, whatever the dictionary, and it looks
#: for no match in the last eight bytes.
PAD, TAIL = b"\n" * 96, b"\n" * 16
PIECE = 2048
UNKNOWN = "und"
#: A margin below this share of the second-best encoding is narrow; in a text under ``SHORT`` characters, whose right margins are smaller
#: too, below 0.6 of it. Set from labelled rows outside the dictionaries (sf0.1, cut to 15 to 4000 characters).
NARROW, SHORT = 0.05, 300


def normalised(text: str) -> bytes:
    return (" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", pieces: int = 400, piece_chars: int = 300, most_languages: int = 500) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows.

    The fit takes a bounded sample: from each language at most ``pieces`` texts (the one with the smallest text hash in each
    of that many hash buckets), and of each ``piece_chars`` characters from a place given by the hash. Rows with null text or
    language teach nothing. More than ``most_languages`` labels is an error, as the dictionaries travel to every task.
    """
    h = F.xxhash64(text)
    start = F.pmod(h, F.greatest(F.lit(1), F.char_length(text) - piece_chars + 1)).cast("int") + 1
    picked = (
        rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        .select(F.col(lang).alias("lang"), F.pmod(h, F.lit(pieces)).alias("bucket"), F.struct(h.alias("h"), F.substring(F.col(text), start, F.lit(piece_chars)).alias("piece")).alias("one"))
        .groupBy("lang", "bucket").agg(F.min("one").alias("one"))
    )
    if (n := picked.agg(F.countDistinct("lang")).first()[0]) > most_languages:
        raise ValueError(f"{n} languages; the limit is {most_languages}")
    held: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", "bucket").collect():  # bounded: languages x pieces
        held.setdefault(row["lang"], []).append(normalised(row["one"]["piece"]))
    return {k: b"".join(v) for k, v in held.items()}


def encoders(dictionaries: dict[str, bytes], level: int, min_match: int) -> list[tuple[str, Callable[[bytes], bytes]]]:
    found = []
    for name in sorted(dictionaries):
        content = dictionaries[name]
        params = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=PIECE + len(PAD + TAIL), dict_size=len(content), min_match=min_match, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        if len(content) < 8:  # zstandard takes no shorter dictionary
            found.append((name, zstandard.ZstdCompressor(compression_params=params).compress))
            continue
        coded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coded.precompute_compress(compression_params=params)
        found.append((name, zstandard.ZstdCompressor(dict_data=coded, compression_params=params).compress))
    return found


def classifier(dictionaries: dict[str, bytes], level: int = 5) -> Callable[[str | None], tuple[str, float]]:
    """Text to (language, margin): how much longer the second-best encoding is, as a share of it.

    Matches of four bytes and more count; a tie, as very short texts have it, is encoded again with matches of three.
    """
    coarse, fine = encoders(dictionaries, level, 4), encoders(dictionaries, level, 3)

    def classify(text: str | None) -> tuple[str, float]:
        if not coarse or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = normalised(text)
        parts = [PAD + data[i : i + PIECE] + TAIL for i in range(0, len(data), PIECE)]
        for coders in (coarse, fine):
            sizes = sorted((sum([len(coder(p)) for p in parts]), name) for name, coder in coders)
            margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            if margin:
                break
        return sizes[0][1], margin

    return classify


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = NARROW) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``.

    The whole text, in lower case and without anything but letters, is encoded in pieces with each dictionary; the smallest
    sum wins, ties go to the first name. Null texts and texts without a letter are ``und`` with score 0. A text is rejected when it is ``und``
    or its margin is below ``min_margin`` (0.6 of it for short texts), a share, so that the bytes it asks for grow with the text. One
    dictionary alone has no rival and rejects only ``und``. Columns with those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most most_languages dictionaries of fixed size

    def make():
        classify = classifier(shared.value)

        def find(texts):
            got = [classify(t) for t in texts]
            return [g[0] for g in got], [g[1] for g in got], [g[0] == UNKNOWN or g[1] < min_margin * (0.6 if len(t) < SHORT else 1) for g, t in zip(got, texts)]

        return find

    return with_computed(docs, text, "lang_pred string, score double, rejected boolean", make)
