"""Content classifiers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of academic papers, looked for in the first 2000 characters (fixed values).
ACADEMIC = (
    "摘要：", "关键词：", "中图分类号：", "文献标志码：", "文章编号：",
    "Abstract:", "Keywords:", "DOI:", "引用格式：",
    "收稿日期：", "基金项目：", "作者简介：",
    "1  ", "2  ", "1.1  ", "2.1  ",
    "表", "图", "参考文献", "Reference",
)
#: Marks of books (fixed values). 版版权所有 is one entry; the bracketed entries are plain strings, too.
BOOK = (
    "目录", "Contents", "CONTENTS", "目  录",
    "第1章", "第一章", "Chapter 1", "CHAPTER 1",
    "第1节", "第一节", "Section 1", "SECTION 1",
    "开本：", "丛书名：", "责任编辑：", "出版社",
    "前言", "序言", "绪论", "导论",
    "后记", "跋", "索引", "术语表",
    "部", "版版权所有", "Copyright", "©", "All rights reserved",
    "翻印必究", "侵权必究",
    "第[一二三四五六七八九十]+章", "第[一二三四五六七八九十]+节", "第[0-9]+章", "第[0-9]+节",
    "本书", "本教材", "本教程", "本专著",
    "读者", "学习者", "教学使用", "自学",
    "习题", "练习题", "思考题",
    "图书在版编目", "CIP数据", "中国版本图书馆",
    "出版发行", "印刷", "装帧", "印张",
)
#: Patterns of books, and marks of papers that rule a book out (fixed values).
BOOK_PATTERNS = ("第[一二三四五六七八九十]+章", "第[0-9]+章", r"ISBN[:：]\s*[0-9]+[- ][0-9]+[- ][0-9]+[- ][0-9]+[- ][0-9]")
PAPER = ("摘要", "关键词", "参考文献", "DOI:", "基金项目：", "作者简介：")
#: Kinds of books, the first match counts (fixed values).
BOOK_TYPES = (
    ("textbook", "教材|教程|教科书|教学|习题|练习题|例题|思考题"),
    ("novel", "小说|故事|情节|人物|主角|第[一二三四五六七八九十]+回"),
    ("manual", "手册|指南|使用说明|操作指南|安装指南|用户手册"),
    ("reference", "词典|辞典|百科全书|大全|参考书|资料"),
    ("academic", "研究|学术|理论|方法论|专著|论文集"),
)
#: Words of novels and of drug leaflets (fixed values).
NOVEL_WORDS, DRUG_WORDS = "情节|人物|角色|叙事|结局|剧情", "医|药"
#: Questions that need a person's decision, in the order of the labels (fixed values).
UNSUITABLE = (
    ("hospital_regulations", r"\b(parking|refund|billing|complaint|appointment policy|rule|regulation)\b"),
    ("medical_law", r"\b(lawsuit|legal|malpractice|sue|court)\b"),
    ("physician_privacy", r"\b(doctor\s*(phone|address)|physician\s*(phone|address)|personal\s*info)\b"),
    ("disruptive", r"\b(bypass|fake|forge|avoid\s*paying)\b"),
)


def _count(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])


def is_academic(text: Column) -> Column:
    head = F.substring(text, 1, 2000)
    return reduce(lambda a, b: a | b, [head.contains(x) for x in ACADEMIC])


def is_book(text: Column) -> Column:
    head = F.substring(text, 1, 3000)
    paper = (_count([head.contains(x) for x in PAPER]) >= 2) | is_academic(text)
    marks = (_count([text.contains(x) for x in BOOK]) >= 2) | (_count([text.rlike(x) for x in BOOK_PATTERNS]) >= 2)
    return ~paper & marks


def book_type(text: Column) -> Column:
    head = F.substring(text, 1, 5000)
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in BOOK_TYPES:
        out = out.when(head.rlike(pattern), F.lit(name))
    words = F.size(F.filter(F.split(head, r"\s+"), lambda w: w != ""))
    out = out.when(head.rlike(NOVEL_WORDS) & (words > 200), F.lit("novel"))
    return out.when(head.rlike(DRUG_WORDS), F.lit("drug")).otherwise(F.lit("unknown"))


def unsuitable_labels(question: Column) -> Column:
    """All labels that apply, in their order."""
    low = F.lower(question)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in UNSUITABLE]), lambda x: x.isNotNull())


def route(text: Column) -> Column:
    """Which splitter a document takes: book, academic or generic."""
    sample = F.substring(text, 1, 3000)
    return F.when(is_book(sample), F.lit("book")).when(is_academic(sample), F.lit("academic")).otherwise(F.lit("generic"))
