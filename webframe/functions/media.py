"""Judging media addresses and media bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from webframe.functions.common import col_of, let
from webframe.functions.matching import first_letters
from webframe.functions.urls import url_part

# What speaks for and against a media address.
MEDIA_EXT = r"(?i)\.(?:mp3|m4a|flac|wav|aac|ogg|oga|ape|wma|opus|mp4|m4v|webm|mkv|mov|m3u8|mpd)(?:$|[?#])"
URLISH_PATH = r"(?i)/(?:url|play|song|music|audio|media|download|stream|source|convert|listen|anti)(?:[/_.-]|$)"
NOT_MEDIA = (
    r"(?i)\.(?:apk|exe|msi|dmg|pkg|deb|rpm|appx|ipa|crx|xpi|"
    r"zip|rar|7z|tar|gz|bz2|xz|cab|"
    r"jpg|jpeg|png|gif|webp|bmp|svg|ico|tiff?|"
    r"css|js|mjs|json|xml|txt|html?|pdf|doc[xm]?|xls[xm]?|ppt[xm]?|"
    r"torrent|woff2?|ttf|eot|map)(?:$|[?#])"
)
NOISE = (
    r"(?i)kwplayer|autolite|pkgdown|/mbox/|update|upgrade|client|setup|installer|"
    r"analytics|gtag|collect|beacon|log\.|/log/|track|report|ads?[/_.-]|advert|banner|"
    r"popConfig|feedback|weblog|statistic|monitor"
)
FIELD_HINT = (
    r"(?i)url|uri|link|src|source|play|listen|download|stream|audio|music|media|"
    r"song|album|author|artist|singer|name|rid|id"
)
FIELD_NOISE = (
    r"(?i)pic|image|cover|avatar|icon|logo|poster|thumb|head|face|"
    r"lyric|lrc|text|desc|comment|reply|share|page|prev|next"
)
# Containers, their extension, and which of them play.
KIND_EXT = {
    "mp4": ".mp4", "m4a": ".m4a", "mp3": ".mp3", "matroska": ".webm", "mpegts": ".ts", "flv": ".flv", "avi": ".avi",
    "ogg": ".ogg", "flac": ".flac", "wav": ".wav", "webp": ".webp", "png": ".png", "jpeg": ".jpg",
}
PLAYABLE = ("mp4", "m4a", "mp3", "matroska", "mpegts", "flv", "ogg", "flac", "wav")
MOOV_BUDGET = 6 * 1024 * 1024


def media_url_ok(url) -> Column:
    """Neither a known non-media file nor a client, statistics or ad address."""
    u = col_of(url)
    return ~u.rlike(NOT_MEDIA) & ~u.rlike(first_letters(NOISE))


def media_score(url, field="") -> Column:
    """How much an address looks like playable media; 0 or less means it does not."""
    field = field if isinstance(field, Column) else F.lit(field)
    pair = F.struct(F.coalesce(col_of(url), F.lit("")).alias("u"), F.coalesce(field, F.lit("")).alias("f"))

    def score(s: Column) -> Column:
        u, f = s["u"], s["f"]
        part = lambda hit, n: F.when(hit, n).otherwise(0)
        total = (
            part(u.rlike(MEDIA_EXT), 60) + part(url_part(u, "path").rlike(URLISH_PATH), 25)
            + part(f.rlike(FIELD_HINT), 20) + part(f.rlike(FIELD_NOISE), -15) + part(u.startswith("https://"), 2)
        )
        return F.when(u.rlike(NOT_MEDIA), 0).when(u.rlike(first_letters(NOISE)), -50).when(F.length(u) < 16, 0).otherwise(total)

    return let(pair, score)


def _hex(content, start: int, n: int) -> Column:
    return F.hex(F.substring(col_of(content), start, n))


@F.pandas_udf(StringType())
def _mpeg_frame(heads: pd.Series) -> pd.Series:
    """'mp3' when an MPEG audio frame starts in the head, an ID3 tag skipped."""

    def one(b):
        if not b:
            return None
        at = 0
        if b[:3] == b"ID3" and len(b) >= 10 and all(x < 128 for x in b[6:10]):
            at = 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9])
        elif b[:3] == b"ID3":
            at = 10
        while True:
            at = b.find(b"\xff", at)
            if at < 0 or at + 1 >= len(b):
                return None
            if b[at + 1] & 0xE0 == 0xE0 and (b[at + 1] >> 1) & 3:
                return "mp3"
            at += 1

    return heads.map(one)


def sniff_kind(head) -> Column:
    """Container by magic bytes; the loose MPEG frame search comes last and only where needed."""
    h = col_of(head)
    riff = lambda kind: (_hex(h, 1, 4) == "52494646") & (_hex(h, 9, 4) == kind)
    sure = (
        F.when(_hex(h, 5, 4) == "66747970", "mp4")
        .when(_hex(h, 1, 4) == "1A45DFA3", "matroska")
        .when((_hex(h, 1, 1) == "47") & (F.octet_length(h) > 376) & (_hex(h, 189, 1) == "47"), "mpegts")
        .when(_hex(h, 1, 3) == "464C56", "flv")
        .when(riff("41564920"), "avi").when(riff("57415645"), "wav")
        .when(_hex(h, 1, 4) == "4F676753", "ogg").when(_hex(h, 1, 4) == "664C6143", "flac")
        .when(riff("57454250"), "webp")
        .when(_hex(h, 1, 8) == "89504E470D0A1A0A", "png").when(_hex(h, 1, 3) == "FFD8FF", "jpeg")
    )
    enough = F.octet_length(h) >= 12
    return F.when(enough, F.coalesce(sure, _mpeg_frame(F.when(enough & sure.isNull(), h))))


def looks_like_audio(head) -> Column:
    h = col_of(head)
    first2 = F.conv(_hex(h, 1, 2), 16, 10).try_cast("int")
    return (
        F.when(F.coalesce(F.octet_length(h), F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(_hex(h, 1, 3) == "494433", "mp3")
        .when(_hex(h, 1, 2).isin("FFFB", "FFF3", "FFF2"), "mp3")
        .when(_hex(h, 1, 4) == "664C6143", "flac").when(_hex(h, 1, 4) == "4F676753", "ogg")
        .when(_hex(h, 1, 4) == "52494646", "wav/riff")
        .when((F.octet_length(h) >= 2) & (first2 >= 0xFFE0), "mp3")
        .when((F.octet_length(h) >= 12) & (_hex(h, 5, 4) == "66747970"), "mp4/m4a")
    )


def has_moov(content, budget: int = MOOV_BUDGET) -> Column:
    """Is the MP4 index in the first or last bytes?"""
    c = col_of(content)
    mark = F.unhex(F.lit("6D6F6F76"))
    tail = F.substring(c, F.greatest(F.lit(1), F.octet_length(c) - budget + 1), F.lit(budget))
    return F.contains(F.substring(c, 1, budget), mark) | F.contains(tail, mark)
