"""Cue words and ordered rules read from posting text, and the skill taxonomy."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.text import EMPLOYMENT_RULES, REMOTE_RULES, Cue


# Section cues, role families, seniority levels and the salary shape.
# Rule order decides which label wins.
SECTION_CUES = {
    "preferred": Cue(
        ["preferred", "nice to have", "bonus", "plus"],
        free=["加分项", "优先考虑", "优先", "更佳", "有加分", "附加要求", "有以下经验者优先"],
    ),
    "required": Cue(
        ["required", "must have", "minimum qualifications", "you have", "basic qualifications"],
        free=[
            "任职资格", "任职要求", "岗位要求", "岗位描述", "应聘要求", "招聘要求", "工作要求",
            "具备能力", "基本要求", "必备技能", "必备条件", "要求", "资格要求",
        ],
    ),
    "responsibilities": Cue(
        ["responsibilities", "what you will do", "in this role"],
        shapes=[("what you", "what you.ll do")],
        free=[
            "岗位职责", "工作职责", "职位职责", "工作内容", "岗位内容", "主要职责", "职责描述",
            "你将负责", "工作描述",
        ],
    ),
    "qualifications": Cue(
        ["qualifications", "requirements", "what you bring"],
        free=[
            "任职资格", "任职要求", "岗位要求", "职位要求", "资格要求", "应聘要求", "招聘要求",
            "工作要求", "要求",
        ],
    ),
}
ROLE_FAMILY_RULES = [
    ("hardware", Cue(
        ["fpga", "rtl", "verilog", "systemverilog", "asic", "timing", "silicon"],
        free=["嵌入式", "硬件工程师", "芯片", "集成电路", "射频", "模拟电路", "数字电路"],
    )),
    ("photonics", Cue(
        ["photonics", "optical", "pic", "silicon photonics"],
        free=["光子", "光电", "光通信", "硅光"],
    )),
    ("machine-learning", Cue(
        ["machine learning", "deep learning", "llm", "model"],
        free=[
            "机器学习", "深度学习", "大模型", "大语言模型", "算法工程师", "算法研究员", "nlp",
            "自然语言", "计算机视觉", "多模态", "推荐系统", "搜索算法", "强化学习",
        ],
    )),
    ("data", Cue(
        ["sql", "analytics", "warehouse", "etl", "data engineer"],
        free=[
            "数据工程", "数据分析", "数据开发", "数据仓库", "数据科学", "数据挖掘", "大数据",
            "商业分析", "bi",
        ],
    )),
    ("software", Cue(
        ["python", "c++", "java", "backend", "frontend", "full stack"],
        free=[
            "后端", "后台", "服务端", "前端", "全栈", "web开发", "微服务", "分布式", "高并发",
            "移动端", "客户端", "android", "ios", "游戏开发", "测试开发", "qa", "devops", "运维",
            "安全", "sre",
        ],
    )),
]
SENIORITY_RULES = [
    ("intern", Cue(["intern", "internship"], free=["实习生", "实习"])),
    ("entry", Cue(
        ["junior", "entry level", "entry-level"],
        free=["应届", "校招", "校园招聘", "初级", "入门"],
    )),
    ("staff", Cue(["staff"])),
    ("principal", Cue(["principal"], free=["首席", "主任工程师"])),
    ("senior", Cue(["senior"], free=["高级", "资深", "专家", "架构师"])),
    ("lead", Cue(["lead"], free=["主管", "组长", "技术负责人", "leader"])),
    ("manager", Cue(["manager"], free=["经理", "主管", "总监"])),
]
SALARY = (
    r"(?:\$|USD\s*)?\d{2,3}(?:[,\d]{0,6})\s*(?:-|to)\s*(?:\$|USD\s*)?\d{2,3}(?:[,\d]{0,6})"
)
BULLET_MARKS = " -•·、"
SENTENCE_END = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+|(?<=[。！？；])"
CJK = "[一-鿿]"


@dataclass(frozen=True)
class Rules:
    """Every cue the text jobs use; swap any of them for another language or domain."""

    sections: dict[str, Cue] = field(default_factory=lambda: dict(SECTION_CUES))
    role_families: list[tuple[str, Cue]] = field(default_factory=lambda: list(ROLE_FAMILY_RULES))
    seniority: list[tuple[str, Cue]] = field(default_factory=lambda: list(SENIORITY_RULES))
    remote: list[tuple[str, Cue]] = field(default_factory=lambda: list(REMOTE_RULES))
    employment: list[tuple[str, Cue]] = field(default_factory=lambda: list(EMPLOYMENT_RULES))
    salary: str = SALARY


@dataclass(frozen=True)
class Skill:
    """One taxonomy entry, in taxonomy order."""

    skill_id: str
    label: str
    normalized_label: str
    aliases: tuple[str, ...] = ()
    parent_id: str | None = None
    category: str | None = None


def _slug(label: str) -> str:
    return re.sub("[^a-z0-9]+", "-", label.lower()).strip("-") or "unknown"


def load_taxonomy(source: str | dict) -> list[Skill]:
    """``{normalized label: {id, label, aliases, parent_id, category}}``, as a dict or a JSON file."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as handle:
            source = json.load(handle)
    return [
        Skill(
            skill_id=meta.get("id") or "skill:" + _slug(name),
            label=meta.get("label") or name.title(),
            normalized_label=name,
            aliases=tuple(meta.get("aliases", ())),
            parent_id=meta.get("parent_id"),
            category=meta.get("category"),
        )
        for name, meta in source.items()
    ]


def read_taxonomy(spark: SparkSession, path: str) -> list[Skill]:
    """The taxonomy of a JSON file, or of the files of a folder, in any store that Spark reads."""
    merged: dict = {}
    for row in spark.read.text(path, wholetext=True).orderBy("value").collect():
        merged.update(json.loads(row.value))
    return load_taxonomy(merged)


def taxonomy_records(taxonomy: list[Skill]) -> list[dict]:
    return [
        {
            "normalized_label": s.normalized_label,
            "skill_id": s.skill_id,
            "label": s.label,
            "aliases": list(s.aliases),
            "parent_id": s.parent_id,
            "category": s.category,
        }
        for s in taxonomy
    ]


def taxonomy_hash(taxonomy: list[Skill]) -> str:
    """SHA-256 of the taxonomy as compact JSON with sorted keys."""
    canonical = json.dumps(
        taxonomy_records(taxonomy), ensure_ascii=False, sort_keys=True, separators=(",", ":")
    )
    return hashlib.sha256(canonical.encode()).hexdigest()
