"""No class word and no depth may lose the text of a page."""

import pytest

from flowguard.llm import wrappers

TEXT = "<h1>Head</h1><p>one long paragraph of the article</p><p>and one more of it</p>"
WHOLE = "Head\n\none long paragraph of the article\n\nand one more of it"

KEPT = [
    f"<body><nav>m</nav><div class='content has-sidebar'>{TEXT}</div></body>",
    f"<body><div class='layout no-sidebar'><article>{TEXT}</article></div><footer>f</footer></body>",
    f"<body><div id='related-work'>{TEXT}</div></body>",
    f"<body><header>h</header><section class='post ad-free'>{TEXT}</section></body>",
    f"<body><form id=f><input>{TEXT}</form></body>",
    "<body>" + "<div>" * 160 + "<nav>MENU</nav>" + TEXT + "</div>" * 160 + "</body>",
    f"<body><div class='sidebar comments'>{TEXT}<nav>n</nav><div class=ad>Buy</div></div></body>",
]


@pytest.mark.parametrize("number", range(len(KEPT)))
def test_the_text_stays(spark, number):
    rows = spark.createDataFrame([(1, "http://h.com/1", KEPT[number])], "page_id long, url string, html string")
    text = wrappers.extract_pages(rows).first().text
    assert [b for b in text.split("\n\n")] == WHOLE.split("\n\n")


def test_what_is_an_aside_stays_one():
    short = "<body><article><p>short</p></article><div class=comments><p>" + "a long comment " * 40 + "</p></div><div class='no ad'>kept out</div></body>"
    assert wrappers.extract(short, [["body>article"]]) == "short"
    assert wrappers.extract("<body><nav>only a menu</nav></body>", None) == ""
