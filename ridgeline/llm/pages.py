"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the blocks before and after it, the kind of its own
tag, and weaker marks of the elements around it: whether one of them is the page's article, whether one is an element for other things by its tag or role
(navigation, footer, form, ...), and what the classes and ids of containers say. A decision tree grown on ``EXAMPLES``, a small table of
labelled blocks, takes or leaves each block; taken blocks are joined in page order. ``HELD_OUT`` are labelled blocks that it doesn't grow on.

Defined results: a null or empty page gives an empty text; comments, scripts, styles and markup never count; an unclosed tag at the end of a page
is dropped, an unclosed comment or script reaches to the end; line breaks are white space; broken character
references stay as they are; text inside elements that aren't block-level (formulas, drawings, fallbacks of media) belongs to the block around it; a very long or deeply nested
page takes time in proportion to its length; repeated rows are extracted alike; an empty table gives an empty result; a column of any name beside the three that are read does no harm.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, field, nested, slices, struct_rows

# Element names of HTML by role. What is in neither set is inline.
RAW = {"script", "style", "noscript", "template", "textarea", "select", "button", "iframe", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTED = {"li", "td", "th", "option"}
FLOWING = {"p", "blockquote", "pre", "dt", "dd", "figcaption", "caption", "address", "summary", "hgroup"} | HEADINGS | LISTED
CONTAINERS = {
    "article", "aside", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "frameset", "head", "header", "hr", "html", "legend", "main", "menu", "nav", "noframes",
    "ol", "optgroup", "search", "section", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
BLOCKS = FLOWING | CONTAINERS
OTHER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "search"}
MAIN_TAGS = {"article", "main"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar"}
OTHER_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr",
    "login", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "topbar", "widget",
}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: The labelled table that the tree grows on, blocks of pages of several layouts: a block's words and link density, those of the block before and after, its own tag's kind (0 a paragraph or
#: the like, 1 a heading, 2 an item or cell, 3 a container), inside (2 in the page's article and nothing else, 0 outside of it, 1 on a page that has none), other (1 in an element that is
#: for other things by its tag or role), named (what the names of containers say: 1 other things, -1 the article); then whether it is main text.
EXAMPLES = """
words link  bwords blink  awords alink  kind inside other named  text
1     1.00  0      0.00   1      1.00   2    1      0     0      0
1     1.00  1      1.00   2      1.00   2    1      0     0      0
2     1.00  1      1.00   1      1.00   2    1      0     0      0
5     0.00  1      1.00   39     0.00   1    1      0     0      1
39    0.00  5      0.00   33     0.00   0    1      0     0      1
33    0.00  39     0.00   4      0.00   0    1      0     0      1
79    0.00  4      0.00   7      0.00   0    1      0     0      1
7     0.00  79     0.00   3      1.00   0    1      0     0      1
3     1.00  7      0.00   7      1.00   2    1      0     0      0
5     1.00  7      1.00   6      0.00   2    1      0     0      0
6     0.00  5      1.00   8      0.25   3    1      0     0      0
8     0.25  6      0.00   0      0.00   3    1      0     1      0
2     1.00  2      0.00   3      1.00   2    0      1     0      0
3     1.00  2      1.00   3      1.00   2    0      1     0      0
3     1.00  3      1.00   1      1.00   2    0      1     0      0
6     0.00  1      1.00   2      0.00   1    2      0     0      1
2     0.00  6      0.00   1      0.00   0    2      0     0      1
1     0.00  2      0.00   1      1.00   2    2      0     0      1
41    0.02  1      1.00   1      0.00   0    2      0     0      1
1     0.00  41     0.02   70     0.00   0    2      0     0      1
70    0.00  1      0.00   2      0.00   0    2      0     0      1
45    0.00  2      0.00   18     0.00   0    0      1     0      0
18    0.00  45     0.00   25     0.00   0    0      1     0      0
25    0.00  18     0.00   0      0.00   0    0      1     0      0
3     0.00  4      1.00   18     0.00   1    1      0     0      1
18    0.00  3      0.00   1      0.00   0    1      0     0      1
1     0.00  18     0.00   9      0.00   2    1      0     0      1
2     0.00  9      0.00   14     0.00   2    1      0     0      1
14    0.00  2      0.00   17     0.00   2    1      0     0      1
17    0.00  14     0.00   46     0.04   0    1      0     0      1
3     1.00  46     0.04   2      1.00   0    1      0     0      0
2     1.00  3      1.00   0      0.00   0    1      0     0      0
27    0.00  0      0.00   5      0.00   0    0      0     1      0
20    0.00  5      0.00   3      0.00   0    2      0     0      1
3     0.00  20     0.00   16     0.00   0    2      0     0      1
16    0.00  3      0.00   60     0.00   3    2      0     1      0
1     0.00  60     0.00   1      1.00   2    2      0     0      1
1     1.00  1      0.00   2      0.00   2    2      0     0      1
2     0.00  1      1.00   1      0.00   0    2      0     0      1
6     0.00  1      0.00   1      0.00   3    0      1     0      0
1     0.00  6      0.00   10     0.00   1    2      0     1      0
10    0.00  1      0.00   35     0.00   0    2      0     1      0
2     0.00  35     0.00   14     0.00   3    0      1     0      0
14    0.00  2      0.00   0      0.00   3    0      1     0      0
2     1.00  1      1.00   3      1.00   2    1      0     0      0
6     1.00  3      1.00   7      1.00   1    1      0     0      0
7     1.00  6      1.00   8      1.00   1    1      0     0      0
8     1.00  7      1.00   9      0.67   3    1      0     0      0
2     1.00  9      0.67   0      0.00   3    1      0     0      0
2     1.00  0      0.00   12     0.00   3    1      0     0      0
12    0.00  2      1.00   141    0.00   0    1      0     -1     1
4     0.00  141    0.00   114    0.00   0    1      0     -1     1
114   0.00  4      0.00   40     0.00   0    1      0     -1     1
40    0.00  114    0.00   12     0.00   0    1      0     1      0
43    0.00  12     0.00   4      0.00   0    1      0     1      0
4     0.00  43     0.00   0      0.00   3    1      0     0      0
2     1.00  0      0.00   2      1.00   2    0      0     0      0
3     1.00  2      1.00   44     0.00   2    0      0     0      0
44    0.00  3      1.00   13     0.00   0    0      0     0      0
13    0.00  44     0.00   4      0.00   3    0      0     0      0
51    0.00  4      0.00   4      1.00   0    2      0     0      1
4     1.00  51     0.00   2      1.00   0    2      0     0      1
2     1.00  4      1.00   2      1.00   2    2      0     0      1
5     1.00  2      1.00   40     0.00   2    2      0     0      1
40    0.00  5      1.00   25     0.00   0    2      0     0      1
25    0.00  40     0.00   2      0.50   3    2      0     0      1
5     1.00  2      0.50   4      1.00   2    0      0     0      0
4     1.00  5      1.00   7      0.00   2    0      0     0      0
7     0.00  4      1.00   0      0.00   0    0      0     0      0
2     1.00  2      0.00   3      1.00   2    1      0     0      0
3     1.00  2      1.00   2      1.00   2    1      0     0      0
2     1.00  3      1.00   7      0.00   2    1      0     0      0
24    0.08  7      0.00   66     0.00   0    1      0     0      1
66    0.00  24     0.08   6      0.00   0    1      0     0      1
6     0.00  66     0.00   15     0.00   2    1      0     0      1
88    0.00  15     0.00   3      0.00   3    1      0     0      1
3     0.00  88     0.00   22     0.00   1    1      0     0      1
22    0.00  3      0.00   3      1.00   0    1      0     0      1
19    0.00  3      1.00   3      1.00   0    1      0     1      0
3     1.00  19     0.00   0      0.00   3    1      0     0      0
3     1.00  0      0.00   1      1.00   3    1      1     0      0
1     1.00  1      1.00   1      1.00   2    1      0     0      0
1     1.00  2      1.00   3      1.00   2    1      0     0      0
3     1.00  1      1.00   8      0.00   2    1      0     0      0
4     0.00  8      0.00   21     0.00   0    1      0     0      1
21    0.00  4      0.00   6      0.00   0    1      0     0      1
6     0.00  21     0.00   27     0.00   0    1      0     0      1
9     1.00  27     0.00   4      1.00   2    1      0     0      0
4     1.00  9      1.00   3      1.00   2    1      0     0      0
3     1.00  4      1.00   5      0.00   2    1      0     0      0
3     1.00  0      0.00   2      1.00   3    1      1     0      0
2     1.00  3      1.00   1      1.00   2    1      0     0      0
1     1.00  2      1.00   4      1.00   2    1      0     0      0
2     1.00  4      1.00   2      1.00   2    1      0     0      0
2     1.00  2      1.00   2      1.00   2    1      0     0      0
2     1.00  2      1.00   8      0.00   2    1      0     0      0
37    0.00  8      0.00   100    0.00   0    1      0     0      1
100   0.00  37     0.00   106    0.00   0    1      0     0      1
106   0.00  100    0.00   9      1.00   0    1      0     0      1
4     1.00  9      1.00   8      1.00   2    1      0     0      0
8     1.00  4      1.00   8      0.00   2    1      0     0      0
8     0.00  8      1.00   0      0.00   0    1      1     0      0
1     1.00  4      1.00   4      1.00   2    1      0     0      0
4     1.00  1      1.00   4      1.00   2    1      0     0      0
4     1.00  4      1.00   4      1.00   2    1      0     0      0
3     1.00  4      1.00   3      1.00   2    1      0     0      0
3     1.00  3      1.00   5      0.00   2    1      0     0      0
5     0.00  3      1.00   140    0.00   1    1      0     0      1
25    0.00  140    0.00   148    0.00   0    1      0     0      1
148   0.00  25     0.00   7      1.00   0    1      0     0      1
7     1.00  148    0.00   6      1.00   2    1      0     0      0
9     1.00  6      1.00   18     0.00   2    1      0     0      0
18    0.00  9      1.00   0      0.00   0    1      1     0      0
1     1.00  3      1.00   3      1.00   2    1      0     0      0
3     1.00  3      1.00   1      1.00   2    1      0     0      0
1     1.00  3      1.00   2      1.00   2    1      0     0      0
2     1.00  1      1.00   4      1.00   2    1      0     0      0
4     0.00  4      1.00   40     0.00   1    1      0     0      1
40    0.00  4      0.00   8      0.00   0    1      0     0      1
8     0.00  40     0.00   3      0.00   0    1      0     0      1
34    0.00  3      0.00   2      1.00   0    1      0     0      1
2     1.00  34     0.00   3      1.00   2    1      0     0      0
3     1.00  2      1.00   7      1.00   2    1      0     0      0
40    0.00  7      1.00   0      0.00   0    1      1     0      0
1     1.00  0      0.00   5      1.00   2    1      0     0      0
5     1.00  1      1.00   2      1.00   2    1      0     0      0
5     1.00  2      1.00   4      1.00   2    1      0     0      0
4     1.00  5      1.00   63     0.00   2    1      0     0      0
63    0.00  4      1.00   11     0.00   0    1      0     0      1
16    0.00  11     0.00   48     0.00   2    1      0     0      1
48    0.00  16     0.00   60     0.00   0    1      0     0      1
60    0.00  48     0.00   3      1.00   0    1      1     0      0
8     1.00  3      1.00   11     0.00   0    1      0     0      0
11    0.00  8      1.00   0      0.00   0    1      1     0      0
2     1.00  0      0.00   2      1.00   2    0      1     0      0
1     1.00  2      1.00   2      1.00   2    0      1     0      0
2     1.00  1      1.00   7      0.00   2    0      1     0      0
7     0.00  2      1.00   1      0.00   1    2      0     0      1
5     0.00  1      0.00   80     0.00   0    2      0     0      1
80    0.00  5      0.00   4      1.00   0    0      1     0      0
4     1.00  80     0.00   3      1.00   2    0      1     0      0
6     1.00  3      1.00   6      1.00   2    0      1     0      0
6     1.00  6      1.00   50     0.00   2    0      1     0      0
50    0.00  6      1.00   0      0.00   0    0      1     0      0
30    0.00  0      0.00   0      0.00   0    2      0     0      1
4     0.00  0      0.00   0      0.00   1    2      0     0      1
40    0.00  0      0.00   0      0.00   0    1      0     0      1
14    0.00  0      0.00   22     0.00   0    1      0     0      1
22    0.00  14     0.00   0      0.00   0    1      0     0      1
3     0.00  0      0.00   31     0.00   3    1      0     0      0
2     0.00  31     0.00   72     0.00   3    1      0     0      0
72    0.00  2      0.00   4      0.00   3    1      0     0      1
4     0.00  72     0.00   0      0.00   3    1      0     0      0
5     0.00  3      0.00   2      0.00   1    1      0     0      1
2     0.00  5      0.00   50     0.00   3    1      0     0      0
50    0.00  2      0.00   43     0.00   0    1      0     0      1
1     0.00  0      0.00   1      1.00   3    1      0     0      0
1     1.00  1      0.00   3      1.00   2    1      0     0      0
3     1.00  1      1.00   2      1.00   2    1      0     0      0
6     0.00  2      1.00   101    0.00   3    1      0     0      0
101   0.00  6      0.00   50     0.00   3    1      0     0      1
50    0.00  101    0.00   3      0.00   3    1      0     0      1
3     0.00  3      0.00   0      0.00   3    1      0     0      0
15    0.00  0      0.00   9      0.00   0    0      0     0      0
9     0.00  15     0.00   30     0.00   3    2      0     0      1
4     0.00  0      0.00   10     0.60   1    2      0     0      1
10    0.60  4      0.00   14     0.36   0    2      0     0      1
14    0.36  10     0.60   9      0.78   0    2      0     0      1
30    0.00  9      0.78   6      0.50   0    2      0     0      1
6     0.50  30     0.00   0      0.00   3    2      0     0      1
40    0.00  0      0.00   21     0.33   0    1      0     0      1
36    0.39  21     0.33   20     0.00   0    1      0     0      1
20    0.00  36     0.39   25     0.00   3    1      0     1      0
25    0.00  20     0.00   5      0.60   0    1      0     0      1
6     0.00  0      0.00   33     0.00   1    2      0     0      1
33    0.00  6      0.00   2      1.00   0    2      0     0      1
2     1.00  33     0.00   2      1.00   2    0      1     0      0
44    0.00  2      1.00   34     0.00   0    2      0     0      1
34    0.00  44     0.00   11     0.00   3    2      0     1      0
11    0.00  34     0.00   9      0.00   0    2      0     0      1
26    0.00  9      0.00   25     0.00   3    2      0     0      1
25    0.00  26     0.00   6      1.00   3    2      0     1      0
6     1.00  25     0.00   5      1.00   2    2      0     1      0
7     1.00  5      1.00   8      1.00   2    2      0     1      0
8     1.00  7      1.00   3      1.00   2    2      0     1      0
3     1.00  8      1.00   4      1.00   2    2      0     0      1
12    0.00  4      1.00   4      1.00   0    0      1     0      0
4     1.00  12     0.00   0      0.00   3    0      1     0      0
12    0.00  0      0.00   2      1.00   0    2      0     0      1
1     1.00  2      1.00   0      0.00   2    2      0     0      1
1     0.00  0      0.00   4      0.00   1    2      0     0      1
4     0.00  1      0.00   1      1.00   0    2      0     0      1
1     0.00  1      1.00   50     0.00   0    2      0     0      1
50    0.00  1      0.00   2      1.00   0    2      0     0      1
2     1.00  50     0.00   0      0.00   2    2      0     0      1
6     1.00  3      0.00   5      0.00   2    2      0     0      1
5     0.00  6      1.00   2      0.00   3    2      0     0      1
2     0.00  5      0.00   2      1.00   3    2      0     0      1
"""

#: Blocks of the same pages that the tree doesn't see.
HELD_OUT = """
words link  bwords blink  awords alink  kind inside other named  text
1     1.00  2      1.00   5      0.00   2    1      0     0      0
4     0.00  33     0.00   79     0.00   1    1      0     0      1
7     1.00  3      1.00   5      1.00   2    1      0     0      0
2     0.00  0      0.00   2      1.00   3    0      1     0      0
1     1.00  3      1.00   6      0.00   2    0      1     0      0
1     1.00  1      0.00   41     0.02   2    2      0     0      1
2     0.00  70     0.00   45     0.00   1    0      1     0      0
4     1.00  0      0.00   3      0.00   3    1      0     1      0
9     0.00  1      0.00   2      0.00   2    1      0     0      1
46    0.04  17     0.00   3      1.00   0    1      0     0      1
5     0.00  27     0.00   20     0.00   1    2      0     0      1
60    0.00  16     0.00   1      0.00   0    2      0     0      1
1     0.00  2      0.00   6      0.00   3    0      1     0      0
35    0.00  10     0.00   2      0.00   0    2      0     1      0
3     1.00  2      1.00   6      1.00   2    1      0     0      0
9     0.67  8      1.00   2      1.00   3    1      0     0      0
141   0.00  12     0.00   4      0.00   0    1      0     -1     1
12    0.00  40     0.00   43     0.00   0    1      0     1      0
2     1.00  2      1.00   3      1.00   2    0      0     0      0
4     0.00  13     0.00   51     0.00   1    2      0     0      1
2     1.00  2      1.00   5      1.00   2    2      0     0      1
2     0.50  25     0.00   5      1.00   3    2      0     1      0
2     0.00  0      0.00   2      1.00   0    1      0     0      0
7     0.00  2      1.00   24     0.08   1    1      0     0      1
15    0.00  6      0.00   88     0.00   2    1      0     0      1
3     1.00  22     0.00   19     0.00   0    1      0     0      0
1     1.00  3      1.00   1      1.00   2    1      0     0      0
8     0.00  3      1.00   4      0.00   1    1      0     0      1
27    0.00  6      0.00   9      1.00   0    1      0     0      1
5     0.00  3      1.00   0      0.00   0    1      1     0      0
4     1.00  1      1.00   2      1.00   2    1      0     0      0
8     0.00  2      1.00   37     0.00   1    1      0     0      1
9     1.00  106    0.00   4      1.00   2    1      0     0      0
4     1.00  0      0.00   1      1.00   3    1      1     0      0
4     1.00  4      1.00   3      1.00   2    1      0     0      0
140   0.00  5      0.00   25     0.00   0    1      0     0      1
6     1.00  7      1.00   9      1.00   2    1      0     0      0
3     1.00  1      1.00   3      1.00   2    1      0     0      0
4     1.00  2      1.00   4      0.00   2    1      0     0      0
3     0.00  8      0.00   34     0.00   0    1      0     0      1
7     1.00  3      1.00   40     0.00   2    1      0     0      0
2     1.00  5      1.00   5      1.00   2    1      0     0      0
11    0.00  63     0.00   16     0.00   2    1      0     0      1
3     1.00  60     0.00   8      1.00   0    1      0     0      0
2     1.00  2      1.00   1      1.00   2    0      1     0      0
1     0.00  7      0.00   5      0.00   0    2      0     0      1
3     1.00  4      1.00   6      1.00   2    0      1     0      0
2     0.00  0      0.00   0      0.00   0    2      0     0      1
58    0.00  0      0.00   0      0.00   3    1      0     0      1
31    0.00  3      0.00   2      0.00   3    1      0     0      1
3     0.00  0      0.00   5      0.00   3    1      0     0      0
43    0.00  50     0.00   4      0.00   0    1      0     0      1
2     1.00  3      1.00   6      0.00   2    1      0     0      0
3     0.00  50     0.00   3      0.00   3    1      0     0      0
30    0.00  9      0.00   0      0.00   3    2      0     0      1
9     0.78  14     0.36   30     0.00   0    2      0     0      1
21    0.33  40     0.00   36     0.39   0    1      0     0      1
5     0.60  25     0.00   0      0.00   3    1      0     0      0
2     1.00  2      1.00   44     0.00   2    0      1     0      0
9     0.00  11     0.00   26     0.00   3    2      0     1      0
5     1.00  6      1.00   7      1.00   2    2      0     1      0
4     1.00  3      1.00   12     0.00   2    2      0     0      1
2     1.00  12     0.00   1      1.00   2    2      0     0      1
1     1.00  4      0.00   1      0.00   2    2      0     0      1
3     0.00  0      0.00   6      1.00   1    2      0     0      1
2     1.00  2      0.00   0      0.00   0    2      0     0      1
"""


def read_table(table: str) -> tuple[list[tuple[float, ...]], list[int]]:
    rows = [tuple(map(float, line.split())) for line in table.strip().splitlines()[1:]]
    return [r[:-1] for r in rows], [int(r[-1]) for r in rows]


def examples() -> tuple[list[tuple[float, ...]], list[int]]:
    return read_table(EXAMPLES)


def held_out() -> tuple[list[tuple[float, ...]], list[int]]:
    return read_table(HELD_OUT)


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 8):
    """A decision tree: a label, or (feature, threshold, tree for at most, tree for more). Splits lessen the Gini impurity; of equals the first feature and lowest threshold."""
    ones = sum(labels)
    if not depth or ones in (0, len(labels)):
        return int(2 * ones > len(labels))
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low = [y for r, y in zip(rows, labels) if r[f] <= cut]
            n, k = len(low), sum(low)
            m, j = len(labels) - n, ones - k
            impurity = 2 * k * (n - k) / n + 2 * j * (m - j) / m
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return int(2 * ones > len(labels))
    _, f, cut = best
    parts = [([r for r in rows if (r[f] > cut) == side], [y for r, y in zip(rows, labels) if (r[f] > cut) == side]) for side in (False, True)]
    return f, cut, grow(*parts[0], depth - 1), grow(*parts[1], depth - 1)


@lru_cache(maxsize=1)
def tree():
    return grow(*examples())


def decide(node, row: tuple[float, ...]) -> int:
    while not isinstance(node, int):
        f, cut, low, high = node
        node = high if row[f] > cut else low
    return node


@lru_cache(maxsize=4096)
def marks(tag: str, attributes: str) -> tuple[bool, bool, int, bool]:
    """Whether an element is for other things than the article, whether it is an article, what its names say (1 other things, -1 the article, 0 nothing), and whether it is hidden."""
    other, main, named, hidden = tag in OTHER_TAGS, tag in MAIN_TAGS, 0, False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            if tag in CONTAINERS:  # names of paragraphs, headings and items say nothing
                parts = {p.lower() for p in NAME_PARTS.findall(value)}
                named = 1 if named > 0 or parts & OTHER_NAMES else -1 if named or parts & MAIN_NAMES else 0
        elif name == "role":
            other, main = other or value.lower() in OTHER_ROLES, main or value.lower() in ("main", "article")
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            hidden = True
    return other, main, named, hidden


def kind_of(tag: str) -> int:
    """0 a paragraph or the like, 1 a heading, 2 an item or cell, 3 a container that holds text itself."""
    return 1 if tag in HEADINGS else 2 if tag in LISTED else 0 if tag in FLOWING else 3


class Block:
    __slots__ = ("text", "words", "linked", "kind", "main", "other", "named")

    def __init__(self, text: str, linked: int, kind: int, main: bool, other: bool, named: int):
        self.text, self.words, self.linked = text, text.count(" ") + 1, linked
        self.kind, self.main, self.other, self.named = kind, main, other, named

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words)


#: What stands around text outside of all elements: its tag, then main, other, named and hidden.
OUTSIDE = ("", False, False, 0, False)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, hidden and raw elements left out."""
    out: list[Block] = []
    #: Open block-level elements: tag, then what they and all around them are: main, other, named, hidden; and how many are open by tag.
    stack: list[tuple[str, bool, bool, int, bool]] = []
    still_open: Counter[str] = Counter()
    unended: set[str] = set()  # inline tags that have no end from here on
    held: list[str] = []
    linked: list[str] = []
    links = 0  # open <a>

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                tag, main, other, named, _ = stack[-1] if stack else OUTSIDE
                out.append(Block(text, len(html.unescape("".join(linked)).split()), kind_of(tag), main, other, named))
            held.clear()
            linked.clear()

    def add(text: str) -> None:
        if text and not (stack and stack[-1][4]):
            held.append(text)
            if links:
                linked.append(text)

    at = 0
    match = TOKEN.search(page)
    while match:
        add(page[at : match.start()])
        at = match.end()
        name = match.group(2) or match.group(4)
        if name:
            name = name.lower()
            if not match.group(0).endswith(">"):
                at = len(page)  # cut off inside a tag
                break
            closing = match.group(0).startswith("</")
            attributes = match.group(3) or ""
            if name in RAW:
                if not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
            elif name in BLOCKS:
                flush()
                links = 0
                if closing:
                    while still_open[name]:  # all that is open inside it ends with it
                        ended = stack.pop()[0]
                        still_open[ended] -= 1
                        if ended == name:
                            break
                elif name not in VOID and not attributes.endswith("/"):
                    if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                        still_open[stack.pop()[0]] -= 1
                    _, main, other, named, hidden = stack[-1] if stack else OUTSIDE
                    o, m, n, h = marks(name, attributes)
                    other = other or o or name == "header" and not main
                    stack.append((name, main or m and not other, other, 1 if n > 0 or named > 0 else n or named, hidden or h))
                    still_open[name] += 1
            elif name == "br":
                add(" ")
            elif name == "a":
                links = max(0, links - 1) if closing else 1
                linked.append(" ")
            elif not closing and name not in VOID and name not in unended and attributes and marks(name, attributes)[3]:
                # hidden inline text goes up to the end of its element
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    unended.add(name)
        match = TOKEN.search(page, at)
    add(page[at:])
    flush()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Each block's row in the order of ``EXAMPLES``. inside: 2 in the page's article and in nothing else, 0 outside of it, 1 on a page that has none."""
    outside = 0.0 if any(b.main and not b.other for b in found) else 1.0
    own = [(0, 0.0), *((b.words, b.density) for b in found), (0, 0.0)]
    return [(*own[k + 1], *own[k], *own[k + 2], float(b.kind), 2.0 if b.main and not b.other else outside, float(b.other), float(b.named)) for k, b in enumerate(found)]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    root = tree()
    return "\n\n".join([b.text for b, row in zip(found, features(found)) if decide(root, row)])


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages, then __text: the main text and its characters. Nothing is shuffled."""
    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [main_text(p) for part in slices(batch, 1 << 20) for p in part.to_pylist()]
            yield struct_rows([texts, [len(t) for t in texts]], [("text", pa.string()), ("n_chars", pa.int64())])

    return nested(pages).withColumn("main", arrow_function(run, "struct<text:string,n_chars:bigint>")(field(html_col))).select("row.*", F.col("main").alias("__text"))


def page_report(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "__text.*")


def pages_sql() -> str:
    """The report in DuckDB's SQL for pages like the test tables', whose articles hold only headings, paragraphs, bold text and line breaks."""
    return r"""
        with a as (select page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(b|br)>', ' ', 'g') as body from pages),
        b as (
            select page_id, url, unnest(regexp_split_to_array(body, '</?(p|h1)>')) as part, generate_subscripts(regexp_split_to_array(body, '</?(p|h1)>'), 1) as k from a
        ), c as (select page_id, url, k, trim(regexp_replace(regexp_replace(replace(part, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as part from b),
        d as (select page_id, url, coalesce(string_agg(part, chr(10) || chr(10) order by k) filter (where part <> ''), '') as text from c group by page_id, url)
        select page_id, url, text, cast(length(text) as bigint) as n_chars from d"""
