"""Search texts in Korean to a filter and what is left for the encoder. Runs on the driver: a text has a few words.

Parsing has two passes. The first lists what each word may mean, by itself and by the names known, and
takes the first meaning. The second folds the meanings whose chips are on into one filter; only there do
months and seasons, which name no year, get one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta, tzinfo

# The words that the parser knows.
PLACE_TAILS = ("에서는", "에서의", "에서", "으로", "까지", "부터", "근처", "쪽", "에", "의", "로")
PARTICLES = ("에서는", "에서", "으로", "이랑", "까지", "부터", "에게", "에", "의", "을", "를", "은", "는", "이", "가", "도", "만")
MEDIA = {"video": ("동영상", ("영상", "동영상", "비디오")), "image": ("사진", ("사진",))}
FILLER = ("나오는", "나온", "찍은", "찍힌", "있는", "보이는", "담긴", "촬영한", "중", "중에")
#: Label, words, unit, and how many of it ago.
RELATIVE = (
    ("올해", ("올해", "금년"), "year", 0),
    ("작년", ("작년", "지난해"), "year", 1),
    ("재작년", ("재작년",), "year", 2),
    ("이번 달", ("이번달", "이달"), "month", 0),
    ("지난 달", ("지난달",), "month", 1),
    ("오늘", ("오늘",), "day", 0),
    ("어제", ("어제",), "day", 1),
)
#: Label, words, first and last hour; 24 and more are after midnight.
HOURS = (("밤", ("밤", "야간", "새벽"), (20, 29)), ("낮", ("낮", "오후"), (9, 18)))
#: First month and number of months.
SEASONS = {"봄": (3, 3), "여름": (6, 3), "가을": (9, 3), "겨울": (12, 3)}
YEARS = range(1900, 2201)

_PARTICLE = re.compile(f"(.+?)(?:{'|'.join(PARTICLES)})")
_DATED = re.compile("(?P<month>[0-9]{1,2})월|(?P<year>[0-9]{4})년|(?P<season>봄$|여름|가을|겨울)")


@dataclass
class Query:
    """What a text asks for. start and end are epoch seconds, both included; hours is (first, last), 24 and more after midnight."""

    text: str = ""
    start: int | None = None
    end: int | None = None
    hours: tuple[int, int] | None = None
    tags: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    chips: list[str] = field(default_factory=list)
    media: str | None = None


@dataclass(frozen=True)
class Time:
    """A time that a word names: whole months or days from a start up to a stop, hours of the day, or months of any year."""

    year: int | None = None
    days: tuple[date, date] | None = None
    months: tuple[int, int] | None = None
    hours: tuple[int, int] | None = None

    def within(self, today: date, year: int | None) -> tuple[date, date] | None:
        """Start and stop; months of any year are those of `year`, else the latest that have begun."""
        if not self.months:
            return self.days
        start, count = 12 * (today.year if year is None else year) + self.months[0] - 1, self.months[1]
        if year is None and _months(start, count)[0] > today:
            start -= 12
        return _months(start, count)


@dataclass(frozen=True)
class Meaning:
    """kind: tag, place, media, time or filler."""

    kind: str
    value: object = None
    label: str = ""

    #: Kinds that are shown, and whether a word whose chip is off is text again.
    SHOWN = {"tag": ("태그", True), "place": ("장소", True), "media": ("종류", False), "time": ("시간", False)}

    @property
    def chip(self) -> str | None:
        return f"{self.SHOWN[self.kind][0]}: {self.label}" if self.kind in self.SHOWN else None


def _months(start: int, count: int) -> tuple[date, date]:
    """From a month up to another, both counted from the year 0."""
    first, stop = (date(m // 12, m % 12 + 1, 1) for m in (start, start + count))
    return first, stop


def times(word: str, today: date) -> Iterator[Meaning]:
    """What time the beginning of a word names."""
    this_month = 12 * today.year + today.month - 1
    for label, names, unit, ago in RELATIVE:
        if word.startswith(names):
            year = today.year - ago
            day = today - timedelta(ago)
            found = {"year": Time(year, _months(12 * year, 12)), "month": Time(days=_months(this_month - ago, 1)), "day": Time(days=(day, day + timedelta(1)))}
            yield Meaning("time", found[unit], label)
    for label, names, hours in HOURS:
        if word.startswith(names):
            yield Meaning("time", Time(hours=hours), label)
    dated = _DATED.match(word)
    if dated and dated["season"]:
        yield Meaning("time", Time(months=SEASONS[dated["season"]]), dated["season"])
    elif dated and dated["month"] and 1 <= int(dated["month"]) <= 12:
        yield Meaning("time", Time(months=(int(dated["month"]), 1)), f"{int(dated['month'])}월")
    elif dated and dated["year"] and int(dated["year"]) in YEARS:
        yield Meaning("time", Time(int(dated["year"]), _months(12 * int(dated["year"]), 12)), f"{int(dated['year'])}년")


def meanings(word: str, today: date, tags: list[str], places: list[str]) -> Iterator[Meaning]:
    """All that a word may mean, the one that counts first."""
    cut = _PARTICLE.fullmatch(word)
    forms = (word, cut[1]) if cut else (word,)
    yield from (Meaning("tag", t, t) for t in tags if t in forms)
    called = [p for p in places if word.startswith(p) and word[len(p) :] in ("", *PLACE_TAILS)]
    yield from (Meaning("place", p, p) for p in sorted(called, key=len, reverse=True))
    yield from (Meaning("media", kind, label) for kind, (label, names) in MEDIA.items() if forms[-1] in names)
    yield from times(word, today)
    if not set(forms).isdisjoint(FILLER):
        yield Meaning("filler")


def parse(text: str, now: date, tags: list[str] | None = None, places: list[str] | None = None, disabled: set[str] | None = None, zone: tzinfo = UTC) -> Query:
    """Reads each word as a tag, a place, a kind, a time, filler, or else as text.

    Every reading is a chip. A disabled chip has no effect: words of tags and places go back into the
    text, those of kinds and times vanish, and a disabled year is no hint to a month or season.
    """
    off, words = disabled or set(), text.split()
    read = [(word, next(meanings(word, now, tags or [], places or []), None)) for word in words]
    # any word that names a year dates months and seasons, whatever else it is
    named = (m for word in words for m in times(word, now) if m.value.year is not None and m.chip not in off)
    year = next((m.value.year for m in named), None)
    on = [m for _, m in read if m and m.chip not in off]
    values = lambda kind: list(dict.fromkeys(m.value for m in on if m.kind == kind))
    spans = [span for m in on if m.kind == "time" and (span := m.value.within(now, year))]
    second = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=zone).timestamp())
    return Query(
        text=" ".join(word for word, m in read if m is None or (m.chip in off and m.SHOWN[m.kind][1])),
        start=max((second(a) for a, _ in spans), default=None),
        end=min((second(b) - 1 for _, b in spans), default=None),
        hours=next((m.value.hours for m in reversed(on) if m.kind == "time" and m.value.hours), None),
        tags=values("tag"),
        places=values("place"),
        chips=[m.chip for _, m in read if m and m.chip],
        media=next((m.value for m in reversed(on) if m.kind == "media"), None),
    )


def translate(text: str, words: dict[str, str]) -> tuple[str, bool]:
    """(translation, complete): each word by the longest key that begins it; distinct, joined by commas; incomplete if Hangul is left."""
    out = []
    for word in text.split():
        key = max((k for k in words if word.startswith(k)), key=len, default=None)
        out.append(words[key] if key else word)
    joined = ", ".join(dict.fromkeys(out))
    return joined, not re.search("[가-힣]", joined)
