"""Pages that do not mark their article, in languages with and without stop words."""

import pytest

from monthloom.llm import htmltext as H

MENU = "<div><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></div>"
END = "<footer>&copy; all rights reserved</footer>"
ITALIAN = "Il fiume era alto e la gente della città non poteva passare per la strada che porta alle colline, come si legge nel libro del paese."
RUSSIAN = "Вода в реке была высокой, и люди не могли пройти по дороге, которая ведёт к холмам на востоке, как это было и в том году."
CHINESE = "河水很高,镇上的人们只好沿着旧路离开,到东边的山上去。第二天早上雨停了,大家才慢慢地回到自己的家里,开始修理被水冲坏的房子。"
# no list knows it
MAORI = "Kua piki te wai o te awa, ā, me haere ngā tāngata o te tāone mā te ara tawhito ki ngā puke i te rāwhiti. " * 3
CODE = "for row in table: value = row.total; result.append(value); count = count + 1; print(value, count) " * 3


@pytest.mark.parametrize("text", [ITALIAN, ITALIAN * 2, RUSSIAN, RUSSIAN * 2, CHINESE, CHINESE * 4, MAORI, MAORI[:150], CODE])
def test_unmarked_pages_keep_their_text(text):
    text = " ".join(text.split())
    html = f"<html><body>{MENU}<div><h1>Title</h1><p>{text}</p><p>Ok.</p><p>{text}</p></div>{END}</body></html>"
    assert H.main_text(html) == f"Title\n{text}\nOk.\n{text}"


def test_link_lists_and_marks_are_no_text():
    links = " ".join(f"<a href='/{i}'>kupu{i} tawhito</a>" for i in range(40))
    assert H.main_text(f"<body><div>{links}</div><p>{'=-' * 400}</p>{END}") == ""
    text = " ".join(MAORI.split())
    assert H.main_text(f"<body><div>{links}</div><p>{text}</p><div>{links}</div>") == text
