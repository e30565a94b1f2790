from __future__ import annotations

from datetime import date, datetime, timezone, timedelta

from shoebox import params
from shoebox.plans import parser

NOW = date(2026, 9, 28)
SEOUL = timezone(timedelta(hours=9))


def asked(text, **more):
    q = parser.parse(text, NOW, zone=SEOUL, **more)
    day = lambda t: t and datetime.fromtimestamp(t, SEOUL).date().isoformat()
    return q, day(q.start), day(q.end)


def test_a_year_word_and_a_season_are_one_time():
    q, a, b = asked("작년 여름 바다")
    assert (q.text, a, b) == ("바다", "2025-06-01", "2025-08-31")
    assert q.end % 86400 == (24 - 9) * 3600 - 1
    assert q.chips == ["시간: 작년", "시간: 여름"]


def test_the_latest_season_that_has_begun():
    assert asked("겨울 눈")[1:] == ("2025-12-01", "2026-02-28")
    assert asked("여름")[1] == "2026-06-01"
    assert asked("12월 트리")[1:] == ("2025-12-01", "2025-12-31")
    assert asked("봄")[1:] == ("2026-03-01", "2026-05-31")
    assert asked("봄에")[0].text == "봄에"


def test_relative_days():
    assert asked("오늘")[1:] == ("2026-09-28", "2026-09-28")
    assert asked("어제")[1:] == ("2026-09-27", "2026-09-27")
    assert asked("지난달")[1:] == ("2026-08-01", "2026-08-31")
    assert asked("이번달")[1:] == ("2026-09-01", "2026-09-30")
    assert asked("재작년")[1:] == ("2024-01-01", "2024-12-31")
    assert asked("2023년 3월")[1:] == ("2023-03-01", "2023-03-31")
    assert asked("1800년")[0].text == "1800년"
    assert asked("13월")[0].text == "13월"


def test_hours_kinds_tags_and_filler():
    assert asked("밤 야경")[0].hours == (20, 29) and asked("오후")[0].hours == (9, 18)
    q, *_ = asked("강아지가 나오는 영상", tags=["강아지"])
    assert (q.media, q.tags, q.text) == ("video", ["강아지"], "")
    assert asked("사진")[0].media == "image"


def test_places_take_only_tails_of_places():
    names = ["고양", "강릉", "강릉시"]
    assert asked("고양이", places=names)[0].text == "고양이"
    assert asked("강릉시에서", places=names)[0].places == ["강릉시"]
    assert asked("강릉에", places=names)[0].places == ["강릉"]


def test_disabled_chips():
    q, a, _ = asked("작년 여름 바다", disabled={"시간: 작년"})
    assert (q.text, a) == ("바다", "2026-06-01") and "시간: 작년" in q.chips
    q, *_ = asked("강아지 사진", tags=["강아지"], disabled={"태그: 강아지", "종류: 사진"})
    assert (q.text, q.tags, q.media) == ("강아지", [], None)


def test_translation():
    words = {"바다": "sea", "바다사자": "sea lion"}
    assert parser.translate("바다사자가 바다 바다", words) == ("sea lion, sea", True)
    assert parser.translate("하늘 바다", words) == ("하늘, sea", False)


def test_patches_keep_types():
    p = params.patched(params.Params(), {"burst_gap_sec": 12.7, "unknown": 1, "min_score": 1}, frozenset({"burst_gap_sec", "min_score"}))
    assert (p.burst_gap_sec, p.min_score) == (12, 1.0) and isinstance(p.min_score, float)
