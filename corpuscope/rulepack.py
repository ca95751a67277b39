"""Rule packs: every word list, label and threshold an audit run uses.

The engine itself is language neutral; the default pack below holds the fixed
values of the audit contract (Chinese business documents). Pass another
``RulePack`` to ``analyze``/``build_report`` to change any of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values of the audit contract (labels, word lists, constants).
# ---------------------------------------------------------------------------
READY = "可直接使用"
NEEDS_WORK = "整理后使用"
NOT_READY = "暂不能使用"
UNJUDGED = "尚未判断"
USE_STATUSES = (READY, NEEDS_WORK, NOT_READY)

HIGH = "优先处理"
MEDIUM = "建议处理"
LOW = "后续优化"
PRIORITIES = ("", LOW, MEDIUM, HIGH)

DIRECT = "可直接解析"
SPECIAL = "需特殊处理"
UNAVAILABLE = "暂无法解析"
UNPARSED = "尚未解析"

SCANNED = "已盘点"
PENDING = "待确认资料"
NO_EXTENSION = "无扩展名"

SUPPORTED = {
    ".docx": "Word",
    ".pdf": "PDF",
    ".xlsx": "Excel",
    ".pptx": "PPT",
    ".txt": "文本",
    ".md": "文本",
}
LEGACY = {".doc": "Word（旧格式）", ".xls": "Excel（旧格式）", ".ppt": "PPT（旧格式）"}
OTHER_BUSINESS = {
    ".csv": "表格数据",
    ".rtf": "富文本",
    ".odt": "开放文档",
    ".ods": "开放表格",
    ".odp": "开放演示文稿",
}
DOCUMENT_KINDS = ("Word", "PDF", "Excel", "PPT", "文本", "其他")

JUNK_NAMES = ("thumbs.db", ".ds_store", "desktop.ini")
JUNK_PREFIXES = ("~$", ".~lock.")
JUNK_DIRECTORIES = ("$recycle.bin", "system volume information", "__pycache__")

BAD_FOLDERS = ("新建文件夹", "临时", "临时资料", "其他", "未分类", "待整理")
BAD_STEMS = (
    r"(新建(文档|文件|文件夹)?|未命名|副本|复件)(\s*\(\d+\)|\s*\d+)?",
    r"\d{1,4}",
    r"(最终|最新版|新版本|final)(版)?\s*\d*",
)
COPY_MARKERS = ("副本", "复件", "备份", "copy", "旧版", "历史版", "废弃")
VERSION_WORDS = "最终|最新版|新版本|修订版?|更新版|定稿|草稿|送审稿|发布版|正式版|旧版|历史版|废弃版|备份|副本|复件|copy|final"
ATTACHMENT_PATTERN = "附件|模[板版]"

PHONE = "手机号码"
ID_NUMBER = "身份证号码"
BANK_CARD = "银行卡号码"
EMAIL = "电子邮箱"
SECRECY = "明确密级标识"
SALARY = "个人薪酬数据"
CONTRACT = "合同金额"
RISK_ORDER = (PHONE, ID_NUMBER, BANK_CARD, EMAIL, SECRECY, SALARY, CONTRACT)
HIGH_IMPACT = (ID_NUMBER, BANK_CARD, SECRECY, SALARY, CONTRACT)

CARD_CONTEXT = "银行卡号?|银行账号|银行账户|卡号|账户号码|收款账号"
SECRECY_LEVELS = ("绝密", "机密", "秘密")
SECRECY_LABELS = "(?:文件)?密级|保密级别"
DISTRIBUTION_BANS = "内部机密|仅限内部使用|仅限内部传阅|禁止外传|严禁外传"
SALARY_TERMS = "基本工资|岗位工资|月工资|月薪|年薪|应发工资|实发工资|税前工资|税后工资|工资标准|薪资标准|薪酬标准|工资明细|薪资明细|薪酬明细"
CONTRACT_TERMS = "本合同(?:总)?金额|本协议(?:总)?金额|本合同总价|双方约定的合同金额"
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"

GENERIC_FOLDERS = (
    "资料", "文档", "文件", "知识库", "测试用知识库", "公司资料", "共享资料", "其他", "临时资料", "待整理",
)

ISSUE_UNREADABLE_DEFAULT = "当前无法读取"
ISSUE_SPECIAL_DEFAULT = "需要特殊处理"
ISSUE_LEGACY = "旧版Office文件，建议转换为常用格式"
ISSUE_UNSUPPORTED = "第一版暂不支持读取此类文件"
ISSUE_ENCODING = "文字编码异常，建议重新保存文件"
ISSUE_ENCRYPTED = "文件已加密，需要提供可读取版本"
ISSUE_SCANNED = "疑似扫描文件，需要先识别文字"
ISSUE_PERMISSION = "文件无法访问，请检查权限或是否被占用"
ISSUE_NOT_EXTRACTED = "缺少本地解析组件，请重新安装完整工具"
BLOCKING_WORDS = ("损坏", "加密", "无法访问")

WARN_MERGED = "前10行存在多处或跨行合并单元格，可能是多行表头"
WARN_PREHEADER = "正式表头前存在合并标题、说明或空行"
PREHEADER_MARK = "正式表头前"

ISSUE_DUPLICATE_KEEP = "发现完全相同的资料（建议保留本文件）"
ADVICE_DUPLICATE_KEEP = "请确认保留本文件，其余相同资料不重复入库"
ISSUE_DUPLICATE_DROP = "完全重复资料（不建议重复入库）"
ADVICE_DUPLICATE_DROP = "请与同组资料核对，本文件不建议重复放入知识库"
ISSUE_VERSION = "疑似存在多个版本"
ADVICE_VERSION = "请确认当前正式有效的版本，其余版本不建议重复入库"
DUPLICATE_ID = "重复组%s"
VERSION_ID = "版本组%s"

PENDING_DESCRIPTION = "暂时无法明确归类，需要结合实际用途人工确认"
PENDING_SITUATION = "需要人工确认"
SITUATION_READY = "大部分可以使用"
SITUATION_BLOCKED = "需要优先整理"
SITUATION_PARTLY = "部分资料需要整理"
NO_MAIN_ISSUE = "未发现集中问题"


@dataclass(frozen=True)
class Topic:
    name: str
    description: str
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class ProblemRule:
    label: str
    markers: tuple[str, ...]
    advice: str


@dataclass(frozen=True)
class IssueLabel:
    """One label of the per-topic main-issue vote: markers seen in the issues."""

    label: str
    markers: tuple[str, ...]
    friendly: str


SALES_TOPIC = "销售与客户服务知识库"

TOPICS = (
    Topic(
        "IT系统与运维知识库",
        "IT系统使用、账号权限、故障处理、网络安全和运维资料",
        (
            "IT", "信息技术", "信息化", "信息系统", "系统", "软件", "平台", "账号", "权限", "登录", "网络",
            "服务器", "数据库", "接口", "API", "运维", "故障", "安装", "配置", "备份", "恢复", "监控", "工单",
            "VPN", "防火墙",
        ),
    ),
    Topic(
        "员工办事知识库",
        "人事、行政、考勤、福利和员工日常办事资料",
        (
            "人力", "人事", "人资", "HR", "员工", "招聘", "入职", "离职", "考勤", "休假", "社保", "福利", "培训",
            "行政", "办公", "报销", "差旅",
        ),
    ),
    Topic(
        SALES_TOPIC,
        "销售流程、客户资料、销售话术、案例和客户服务资料",
        (
            "销售", "客户", "商机", "线索", "销售话术", "报价", "投标", "案例", "售前", "售后", "客服", "渠道",
            "经销商",
        ),
    ),
    Topic(
        "产品与解决方案知识库",
        "产品介绍、功能说明、解决方案和技术资料",
        (
            "产品", "解决方案", "功能", "技术参数", "使用说明", "用户手册", "产品手册", "版本发布", "研发",
            "需求说明",
        ),
    ),
    Topic(
        "生产与操作规范知识库",
        "生产、质量、安全、设备、项目交付和操作规范",
        (
            "生产", "质量", "安全", "设备", "操作", "作业", "工艺", "检验", "仓储", "物流", "供应链", "采购",
            "交付", "项目实施",
        ),
    ),
    Topic(
        "公司制度与管理知识库",
        "公司制度、管理办法、组织职责和工作规范",
        (
            "公司制度", "管理制度", "管理办法", "工作规范", "组织架构", "部门职责", "岗位职责", "内控", "会议",
            "公文", "印章", "档案",
        ),
    ),
    Topic(
        "财经与金融知识库",
        "财经资讯、金融市场、证券基金、宏观经济和投资理财资料",
        (
            "财经", "金融", "股票", "证券", "基金", "债券", "期货", "外汇", "银行", "保险", "理财", "投资",
            "行情", "宏观经济", "经济数据", "财报", "上市公司",
        ),
    ),
    Topic(
        "财务与经营知识库",
        "财务制度、预算、付款、税务和经营分析资料",
        (
            "财务", "财经", "财经共享", "会计", "总账", "预算", "付款", "报销", "费用", "发票", "税务", "成本",
            "资金", "资产", "经营分析", "审计", "结算",
        ),
    ),
    Topic(
        "合同与法务知识库",
        "合同模板、法律事务、合规和风险管理资料",
        ("合同", "协议", "法务", "法律", "合规", "风险", "诉讼", "知识产权", "保密协议", "授权书"),
    ),
)

# (anchor keyword, topic that replaces SALES_TOPIC); the first hit wins.
SPECIAL_TOPICS = (
    (
        "经销商",
        Topic("经销商与客户服务知识库", "经销商政策、渠道业务、客户服务、常见问题和售后案例"),
    ),
    (
        "销售助手",
        Topic("门店销售助手知识库", "门店销售流程、产品知识、导购话术、销售技巧和售后应对资料"),
    ),
)

MAIN_ISSUES = (
    IssueLabel(
        "无法正常读取", ("损坏", "加密", "无法访问", "暂不支持", "旧版Office"), "部分资料无法正常读取"
    ),
    IssueLabel("复杂排版文件", ("Excel排版较复杂", "PPT排版较复杂"), "复杂表格或演示文稿需要先整理"),
    IssueLabel("Excel表头需整理", ("Excel表头前有标题或说明",), "部分Excel需要规范表头"),
    IssueLabel("疑似存在多个版本", ("疑似存在多个版本",), "需要确认正式版本"),
    IssueLabel("完全重复资料", ("完全重复资料",), "需要清理重复资料"),
    IssueLabel("疑似扫描文件", ("疑似扫描文件",), "扫描文件需要先识别文字"),
    IssueLabel("可能包含敏感信息", ("可能包含敏感信息",), "需要确认使用范围"),
    IssueLabel("没有读取到有效内容", ("没有读取到有效内容",), "部分资料没有有效内容"),
    IssueLabel("有效内容过少", ("有效内容过少",), "部分资料内容过少"),
    IssueLabel("文件名称或归档位置不清楚", ("文件名称或归档位置不清楚",), "部分资料命名或归档不清楚"),
    IssueLabel(
        "附件/模板资料，建议单独管理", ("附件/模板资料，建议单独管理",), "附件或模板需要集中管理"
    ),
    IssueLabel("超过5年未更新", ("超过5年未更新",), "部分资料需要确认是否仍然有效"),
    IssueLabel("超过3年未更新", ("超过3年未更新",), "部分资料需要确认是否仍在使用"),
)

PROBLEM_DUPLICATES = "重复或多个版本"
PROBLEM_SCANNED = "扫描文件"
PROBLEM_UNREADABLE = "无法正常读取"
PROBLEM_SENSITIVE = "可能包含敏感信息"

PROBLEMS = (
    ProblemRule(
        PROBLEM_DUPLICATES,
        ("完全重复资料", "发现完全相同", "疑似存在多个版本"),
        "把同组文件交给业务负责人确认正式版本。例如保留“员工手册V3（2026正式版）”，将V1、V2标记为历史版本，不要同时进入知识库。",
    ),
    ProblemRule(
        PROBLEM_SCANNED,
        ("疑似扫描文件",),
        "先用OCR识别文字，再重点抽查标题、表格、日期和数字是否准确；确认无误后，保存为可以搜索和复制文字的PDF或Word。",
    ),
    ProblemRule(
        "内容为空或过少",
        ("没有读取到有效内容", "有效内容过少", "内容较短"),
        "打开原文件核对是否为空、是否只有封面或附件说明。例如只有几十个字的制度文件，应补齐正文，或者确认无保留价值后移出待入库范围。",
    ),
    ProblemRule(
        PROBLEM_UNREADABLE,
        ("损坏", "加密", "无法访问", "暂不支持", "旧版Office"),
        "加密文件需提供有权限读取的副本；损坏文件需从备份恢复；旧版或不支持格式建议另存为DOCX、XLSX、PPTX、PDF等常用格式，再重新体检。",
    ),
    ProblemRule(
        PROBLEM_SENSITIVE,
        ("可能包含敏感信息",),
        "先确认谁可以使用，再决定脱敏或单独建受限知识库。例如隐藏身份证号、银行卡号和手机号中间位；薪酬、合同金额等资料应限制可见部门。",
    ),
    ProblemRule(
        "长期未更新",
        ("超过3年未更新", "超过5年未更新"),
        "请资料负责人确认是否仍有效。例如旧考勤制度如已被新制度替代，应标记失效日期并移出正式知识库，只保留在历史档案中。",
    ),
    ProblemRule(
        "命名或归档不清楚",
        ("文件名称或归档位置不清楚",),
        "把“新建文档、最终版、资料1”等名称改为“主题＋版本/日期＋状态”。例如改为“差旅报销制度_V2_2026正式版.docx”。",
    ),
    ProblemRule(
        "附件或模板需单独管理",
        ("附件/模板资料，建议单独管理",),
        "把附件、表单和模板集中放到统一的下载位置；在相关知识说明中补充下载地址，或写明从哪个系统、共享目录获取。通常不需要把附件正文作为主要检索内容。",
    ),
    ProblemRule(
        "Excel表头前有标题或说明",
        ("Excel表头前有标题或说明",),
        "这类表格可以读取，但标题、说明或空行可能被误当成字段名。建议把标题写入文件名或资料说明，让数据区域从单行表头开始，并删除表头前不必要的空行。",
    ),
    ProblemRule(
        "复杂表格或演示文稿",
        ("Excel排版较复杂", "PPT排版较复杂"),
        "Excel建议整理成单行表头、每行一条记录的明细表，并为公式列补充说明；PPT建议按页面补充标题和文字摘要，把重要流程、图表和图片改写成可独立理解的文字。复杂原文件可保留为下载附件。",
    ),
    ProblemRule(
        "文字读取异常",
        ("乱码", "读取异常"),
        "用原软件重新导出或转换格式，并抽查正文是否可正常复制。例如PDF打开正常但复制后是乱码，应重新生成带文本层的PDF。",
    ),
)

LENGTH_BINS = (
    ("500字以内", 0, 500),
    ("500～2,000字", 500, 2000),
    ("2,000～5,000字", 2000, 5000),
    ("5,000～10,000字", 5000, 10000),
    ("10,000字以上", 10000, None),
)
UNCOUNTED_BIN = "暂无法统计"

STATUS_STANDARDS = (
    (READY, "正文可读取，且未发现明显的格式、内容或版本问题。正式上线前仍需业务负责人确认。"),
    (NEEDS_WORK, "资料仍有利用价值，但存在可以修复的问题，需要先完成整理。"),
    (NOT_READY, "当前无法可靠读取，或者属于不应重复入库的文件，需要处理后重新体检。"),
)
STATUS_SUFFIX = {NEEDS_WORK: "需整理后再入库", NOT_READY: "当前不建议入库"}
PRIORITY_NOTES = (
    (HIGH, "不处理就无法正常使用，建议首先解决。"),
    (MEDIUM, "可能影响知识库效果或产生错误口径。"),
    (LOW, "不影响第一阶段建设，可以逐步完善。"),
)
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RulePack:
    """Tunable rules of one audit run; the defaults are the audit contract."""

    topics: tuple[Topic, ...] = TOPICS
    special_topics: tuple[tuple[str, Topic], ...] = SPECIAL_TOPICS
    special_base: str = SALES_TOPIC
    generic_folders: tuple[str, ...] = GENERIC_FOLDERS
    bad_folders: tuple[str, ...] = BAD_FOLDERS
    problems: tuple[ProblemRule, ...] = PROBLEMS
    forced_problem: str = PROBLEM_SENSITIVE
    main_issues: tuple[IssueLabel, ...] = MAIN_ISSUES
    length_bins: tuple[tuple[str, int, int | None], ...] = LENGTH_BINS
    anchor_weight: int = 20
    folder_weight: int = 8
    stem_weight: int = 5
    body_cap: int = 5
    min_topic_score: int = 3
    min_tied_score: int = 8
    max_topics: int = 6
    absorb_min_total: int = 10
    absorb_share: float = 0.8
    tiny_share: float = 0.03
    min_text: int = 50
    short_text: int = 200
    garbled_block: float = 0.3
    garbled_warn: float = 0.1
    old_years: float = 5
    aging_years: float = 3
    min_duplicate_text: int = 20
    min_version_key: int = 3
    top_problems: int = 5
    problem_examples: int = 4
    status_examples: int = 3
    descriptions: dict = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        known = {t.name: t.description for t in self.topics}
        known.update({t.name: t.description for _, t in self.special_topics})
        object.__setattr__(self, "descriptions", known)


DEFAULT_PACK = RulePack()
