"""Schemas and profiles: what is configuration rather than code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TEXT, _LONG, _REAL, _LIST = T.StringType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINKS = _struct(link=_TEXT, duration=_TEXT, title=_TEXT, source=_TEXT, author=_TEXT)

METADATA = _struct(
    id=_TEXT, extractor=_TEXT, channel=_TEXT, channel_id=_TEXT, uploader=_TEXT, uploader_id=_TEXT, title=_TEXT, description=_TEXT,
    timestamp=_LONG, view_count=_LONG, like_count=_LONG, comment_count=_LONG, duration=_REAL, upload_date=_TEXT, webpage_url=_TEXT,
)
#: Read as well, to tell what can be annotated.
METADATA_FILE = T.StructType([*METADATA.fields, T.StructField("ext", _TEXT)])

RULES = _struct(layer=_TEXT, priority=T.IntegerType(), kind=_TEXT, pattern=_TEXT, label=_TEXT)

PLATFORMS = ("youtube", "tiktok", "facebook", "instagram")
LINK_SOURCES = ("Instagram", "TikTok", "YouTube", "Facebook")
#: Files of these kinds hold no picture.
SOUND_ONLY = ("mp3", "m4a")


@dataclass(frozen=True)
class Profile:
    """A topic: its flag, the list-valued and plain keys of its annotations, and whether posts are de-duplicated."""

    name: str
    flag: str
    lists: tuple[str, ...]
    texts: tuple[str, ...]
    ratings: tuple[str, ...]
    flags: tuple[str, ...] = ()
    dedup: bool = False


SUPPLEMENTS = Profile(
    "supplements", "menopause", ("supplements", "symptoms"), ("description", "transcript", "tone", "sentiment", "marketing", "evidence", "content_type"),
    ("usefulness", "misleading", "quality", "emotional_intensity"), ("problem_solution",), dedup=True,
)
PARENTING = Profile(
    "parenting", "topic", ("alternative_strategies",), ("description", "transcript", "sentiment", "parenting_approach", "child_age", "criticism"),
    ("usefulness", "misleading", "quality", "emotional_intensity"), ("asd", "adhd", "anxiety"),
)
PROFILES = {p.name: p for p in (SUPPLEMENTS, PARENTING)}


def posts(profile: Profile) -> T.StructType:
    """The typed columns of a profile's posts: metadata, flags, ratings, lists as texts, and texts."""
    known = {f.name for f in METADATA.fields}
    names = {"description": "AI_description"}
    more = {**{k: T.BooleanType() for k in (profile.flag, *profile.flags)}, **{k: T.IntegerType() for k in profile.ratings}, **{names.get(k, k): _TEXT for k in (*profile.lists, *profile.texts)}}
    return T.StructType([*METADATA.fields, *(T.StructField(k, t) for k, t in more.items() if k not in known)])
