"""Word lists, aliases, limits and wording that results depend on.

Everything in this file is data that has to be equal for results to be equal. It holds no logic.
"""

# --- Fixed values: calculation requests -------------------------------------------------------

OPERATION_KEYWORDS = {
    "sum": ["sum", "total", "合计", "求和", "汇总"],
    "avg": ["avg", "average", "mean", "平均"],
    "max": ["max", "maximum", "最大", "最高"],
    "min": ["min", "minimum", "最小", "最低"],
    "count": ["count", "数量", "条数", "行数", "多少"],
    "ratio": ["ratio", "占比", "比例"],
    "intensity": ["intensity", "强度", "密度"],
    "yoy": ["同比", "year over year", "yoy"],
    "mom": ["环比", "month over month", "mom"],
}
DEFAULT_OPERATIONS = ["sum", "count"]
OPERATION_LABELS = {
    "sum": "合计",
    "avg": "平均值",
    "max": "最大值",
    "min": "最小值",
    "count": "数量",
    "ratio": "占比",
    "intensity": "强度",
    "yoy": "同比",
    "mom": "环比",
}
CALC_HEADER_ALIASES = {
    "scope 1": ["scope 1", "范围一", "范围1"],
    "scope 2": ["scope 2", "范围二", "范围2"],
    "scope 3": ["scope 3", "范围三", "范围3"],
    "amount": ["金额", "amount", "费用", "cost", "支出"],
    "month": ["月份", "month", "期间"],
    "year": ["年份", "year", "年度"],
    "revenue": ["收入", "revenue", "营收"],
    "production": ["产量", "production", "output"],
    "employee": ["员工", "人数", "headcount"],
}
INTENSITY_DENOMINATORS = ["production", "employee", "revenue"]
TIME_HEADERS = ["month", "year"]
CROSS_SHEET_KEYWORDS = ["跨sheet", "跨工作表", "所有工作表", "全部工作表", "合并"]
TIME_TOKENS = [
    "1月", "2月", "3月", "4月", "5月", "6月", "7月", "8月", "9月", "10月", "11月", "12月",
    "q1", "q2", "q3", "q4", "一季度", "二季度", "三季度", "四季度",
    "2024", "2025", "2026",
]
EMPTY_GROUP = "空值"
CROSS_SHEET_NAME = "跨工作表"

# --- Fixed values: result rows and Markdown ----------------------------------------------------

# English column name -> header written to a result sheet, in sheet order.
RESULT_HEADERS = {
    "doc_name": "文档",
    "sheet": "工作表",
    "group_col": "分组字段",
    "group_value": "分组值",
    "column": "数值字段",
    "metric": "指标",
    "value": "结果",
}
MARKDOWN_TITLE = "# 结果表"
MARKDOWN_EMPTY = "# 结果表\n\n暂无可填写内容。"
RESULT_SHEET_TITLE = "结果表"
TRANSFER_SHEET_TITLE = "数据写入结果"

# --- Fixed values: cell grid profiling ---------------------------------------------------------

HEADER_SCAN_ROWS = 8
LAYOUT_SCAN_ROWS = 300
LAYOUT_SCAN_COLUMNS = 20
ROW_BLOCK_SIZE = 8
HEADER_SIGNALS = [
    "指标", "结果", "年份", "月份", "期间", "单位", "scope", "scope1", "scope2", "scope3", "排放量",
    "用量", "金额", "收入", "产量", "文档", "工作表", "数值字段",
]
HEADER_SIGNAL_PREFIX = "scope"
SHEET_TEMPLATE_HINTS = [
    "template", "summary", "result", "report", "form", "blank", "模板", "汇总", "填报", "填表", "回填", "结果", "空白",
]
TITLE_ROW_HINTS = ["汇总", "披露", "模板", "台账", "报表", "数据表", "统计表", "清单", "说明"]
PROFILE_METRIC_ALIASES = {
    "sum": ["sum", "total", "合计", "总计", "汇总", "求和", "总和"],
    "avg": ["avg", "average", "mean", "平均", "平均值"],
    "max": ["max", "maximum", "最大", "最高"],
    "min": ["min", "minimum", "最小", "最低"],
    "count": ["count", "数量", "条数", "行数", "计数"],
    "ratio": ["ratio", "占比", "比例"],
    "intensity": ["intensity", "强度", "密度"],
    "yoy": ["yoy", "同比", "yearoveryear"],
    "mom": ["mom", "环比", "monthovermonth"],
}
SOURCE_HEADER_TOKENS = ["月份", "年份", "scope", "scope1", "scope2", "scope3", "金额", "产量", "收入"]
METRIC_HEADER = "指标"
RESULT_HEADER = "结果"

# --- Fixed values: workbook roles --------------------------------------------------------------

ROLE_TEMPLATE_HINTS = [
    "template", "summary", "result", "report", "form", "blank", "模板", "汇总", "填报", "填表", "回填", "结果", "空白",
    "目标", "目标表", "目标表格",
]
ROLE_SOURCE_HINTS = [
    "detail", "data", "source", "ledger", "raw", "明细", "台账", "原始", "数据", "数据源", "源表",
]
ROLE_TEMPLATE_SHEET_HINTS = ["summary", "result", "report", "form", "汇总", "模板", "填报", "结果"]
ROLE_SOURCE_SHEET_HINTS = ["detail", "data", "ledger", "raw", "明细", "台账", "原始", "数据"]
CALC_TEMPLATE_HINTS = [
    "template", "summary", "result", "report", "form", "blank", "模板", "汇总", "填报", "填表", "回填", "结果", "空白",
]
CALC_SOURCE_HINTS = ["detail", "data", "source", "ledger", "raw", "明细", "台账", "原始", "数据"]
METRIC_HEADER_NAMES = ["指标", "metric", "metrics"]
RESULT_HEADER_NAMES = ["结果", "result", "value", "数值"]

# --- Fixed values: filling ---------------------------------------------------------------------

PLACEHOLDERS = ["", "-", "--", "待填", "待填写", "待补充", "tbd", "n/a", "na", "pending"]
KEY_HEADERS_EXACT = [
    ["id", "key", "code", "编号", "编码", "代码", "标识", "唯一标识", "指标编码", "项目编码"],
    ["单号", "订单号", "合同号", "发票号", "凭证号", "供应商编码", "客户编码"],
    ["名称", "name", "项目", "指标", "科目", "esg指标", "字段", "条目"],
    ["序号", "行号", "no", "number", "index"],
]
KEY_HEADERS_CONTAINED = [
    ["唯一", "编码", "编号", "代码", "id", "code"],
    ["单号", "订单号", "合同号", "发票号", "凭证号"],
    ["名称", "name", "项目", "指标", "科目", "字段", "条目"],
    ["序号", "行号"],
]
LABEL_METRIC_ALIASES = {
    "sum": ["sum", "total", "合计", "总计", "汇总", "求和", "总和", "总额", "总量", "小计", "累计"],
    "avg": ["avg", "average", "mean", "平均", "平均值"],
    "max": ["max", "maximum", "最大", "最高"],
    "min": ["min", "minimum", "最小", "最低"],
    "count": ["count", "数量", "条数", "行数", "计数"],
    "ratio": ["ratio", "占比", "比例"],
    "intensity": ["intensity", "强度", "密度"],
    "yoy": ["yoy", "同比", "yearoveryear"],
    "mom": ["mom", "环比", "monthovermonth"],
}
LABEL_CONTEXT_ALIASES = {
    "amount": ["金额", "费用", "成本", "支出", "amount", "cost", "expense"],
    "emission": ["排放", "排放量", "碳排放", "emission", "emissions"],
    "energy": ["能源", "能耗", "用电", "电量", "energy", "electricity"],
    "water": ["水", "用水", "耗水", "取水", "water"],
    "waste": ["废弃物", "废物", "垃圾", "waste"],
    "revenue": ["收入", "营收", "营业收入", "revenue"],
    "production": ["产量", "产出", "生产量", "production", "output"],
    "employee": ["员工", "人数", "雇员", "headcount", "employee"],
}
LABEL_CONTEXT_IGNORED = ["工作表", "sheet", "数据", "明细", "结果"]
LABEL_CONTEXT_WEIGHTS = {"group_value": 18, "column": 16, "group_col": 8, "sheet": 4}
LABEL_EXACT_SCORE = 70
LABEL_CONTAINED_SCORE = 46
TITLE_LABEL_HINTS = ["汇总", "模板", "报表", "统计表", "数据表", "披露", "说明"]
TITLE_LABEL_METRIC_WORDS = ["合计", "总计", "平均", "最大", "最小", "同比", "环比", "占比"]
FILL_HEADER_ALIASES = {
    "指标": ["指标", "metric", "metrics"],
    "结果": ["结果", "value", "result", "数值"],
    "文档": ["文档", "document", "file"],
    "工作表": ["工作表", "sheet", "worksheet"],
    "数值字段": ["数值字段", "字段", "column", "metric field"],
    "分组字段": ["分组字段", "group by", "group_field"],
    "分组值": ["分组值", "group value", "group"],
}
FILL_HEADER_WEIGHTS = {"指标": 4, "结果": 4, "文档": 1, "工作表": 1, "数值字段": 1}
WRITE_POLICIES = ["only_empty", "allow_same", "force_overwrite"]
SCAN_ROW_BASE, SCAN_ROW_MAX = 40, 1000
SCAN_COLUMN_BASE, SCAN_COLUMN_MAX = 8, 50
# direction, row offset, column offset, distance, score on a blank cell, score on a used cell, confidence
VALUE_POSITIONS = [
    ("right", 0, 1, 1, 0.84, 0.76, "medium"),
    ("right", 0, 2, 2, 0.66, 0.58, "medium"),
    ("right", 0, 3, 3, 0.66, 0.58, "medium"),
    ("down", 1, 0, 1, 0.44, 0.32, "low"),
    ("down", 2, 0, 2, 0.36, 0.24, "low"),
]
REVIEW_REASON_PREFIX = "Review 交叉检查："
RISK_LEVELS = ["low", "medium", "high"]

# --- Fixed values: text segmentation and ranking -----------------------------------------------

SEGMENT_CHARS = 900
SEGMENT_OVERLAP = 120
MIN_SLICE_STEP = 200
SENTENCE_ENDS = "。！？!?；;"
HEADING_MAX_CHARS = 28
HEADING_PUNCTUATION = "。.!?；;：:"
EXCERPT_CHARS = 220
PREVIEW_CHARS = 180
MIN_PAGE_CHARS = 120
NO_LOCATION = "正文定位未标注"
REQUEST_STOP_WORDS = [
    "请", "帮我", "我们", "你", "需要", "内容", "材料", "文档", "文件", "附件", "输出", "整理", "说明", "版本",
    "about", "this", "that", "with", "from", "into", "please", "help", "document", "documents", "file", "files",
]
DOCUMENT_KINDS = {
    "invoice": ["invoice", "发票", "bill"],
    "receipt": ["receipt", "小票", "收据"],
    "contract": ["contract", "合同", "agreement", "协议"],
    "statement": ["statement", "bank", "对账", "流水"],
    "resume": ["resume", "cv", "简历"],
    "report": ["report", "报告", "summary"],
}
DEFAULT_KIND = "general"
REQUIRED_KINDS = {
    "报销": ["invoice", "receipt"],
    "reimbursement": ["invoice", "receipt"],
    "合同": ["contract"],
    "contract": ["contract"],
    "简历": ["resume"],
    "resume": ["resume"],
    "对账": ["statement", "invoice"],
    "reconcile": ["statement", "invoice"],
    "报告": ["report"],
    "report": ["report"],
}
REPORT_KIND_WORDS = ["报告", "report"]
MESSAGE_LABELS = {
    "check_missing": [
        "missing", "缺失", "缺件", "补齐", "核对材料", "缺什么", "少什么", "缺哪些", "缺哪", "是否齐全", "齐全",
        "完整吗", "完整性", "gap",
    ],
    "revise": [
        "revise", "rewrite", "modify", "修改", "润色", "修订", "改写", "重写", "优化措辞", "更正式", "正式一点",
        "更清晰", "整理成稿", "改得",
    ],
    "count": [
        "count", "数量", "统计", "多少", "几份", "算一下", "测算", "核算", "计算", "求和", "合计", "汇总", "平均",
        "平均值", "最大", "最小", "kpi",
    ],
    "summarize": [
        "summary", "summarize", "总结", "概括", "摘要", "整理", "重点", "要点", "提炼", "提要", "概述", "结论",
        "管理层摘要", "一句话总结", "大纲", "提纲", "框架", "outline",
    ],
    "review": [
        "review", "审核", "检查", "校验", "分析", "看一下", "看下", "看看", "帮我看", "阅读", "读一下", "读完",
        "看完", "审阅", "研读", "评估", "有什么问题", "哪里有问题",
    ],
}
CALCULATION_WORDS = [
    "calculate", "calc", "sum", "total", "avg", "average", "计算", "求和", "合计", "汇总", "平均", "最大", "最小",
    "数值", "金额",
]
TABLE_FILL_WORDS = [
    "fill the", "fill template", "fill form", "fill in", "fill out", "populate", "complete the template",
    "write into", "write to", "填表", "回填", "回填到", "填写", "填入", "填到", "写入", "写到", "填报",
]
TABLE_TARGET_WORDS = [
    "template", "form", "blank", "target workbook", "模板", "空白表", "空表", "目标表", "汇总表", "填报表", "待填",
]
WRITE_WORDS = ["填", "写", "回填", "填写", "填入", "填到", "写入"]
DOCUMENT_REFERENCE_WORDS = [
    "文档", "文件", "材料", "附件", "这份", "这些", "报销", "合同", "表格", "excel", "sheet",
]

# --- Fixed values: topic requests --------------------------------------------------------------

TOPIC_REQUEST_WORDS = [
    "esg", "可持续", "可持续发展", "双碳", "气候", "排放", "环境", "社会", "治理", "供应链", "人权", "反舞弊",
    "反腐败", "培训覆盖率", "董事会",
]
GAP_WORDS = ["缺件", "缺失", "齐全", "完整", "覆盖", "缺口", "gap", "coverage"]
KPI_WORDS = ["指标", "kpi", "scope", "排放", "占比", "比例", "覆盖率", "次数", "数据", "台账", "统计", "metric"]
OUTLINE_WORDS = ["章节", "大纲", "outline", "结构", "框架", "披露结构", "目录"]
REPORT_WRITING_WORDS = [
    "生成", "撰写", "写一份", "写成", "输出", "形成", "起草", "草拟", "整理成", "编写", "write", "compose",
    "generate", "draft", "produce",
]
FULL_REPORT_HINTS = [
    "完整报告", "报告正文", "正式报告", "报告初稿", "报告草稿", "全文", "成稿", "一份 esg 报告", "一份esg报告",
    "esg report",
]
SECTION_ONLY_HINTS = ["章节", "这段", "段落", "小节", "section"]
REPORT_WORDS = ["报告", "report"]
LENGTH_MIN, LENGTH_MAX = 300, 20000
LENGTH_DEFAULT = (3000, 2700, 3300)
LENGTH_PATTERN = r"(?i)(\d+(?:,\d{3})*(?:\.\d+)?)\s*(万|千|k|K)?\s*(字|词|words?|word)"
LENGTH_RANGE_PATTERN = r"(?i)(\d+(?:,\d{3})*)\s*(?:-|~|到|至)\s*(\d+(?:,\d{3})*)\s*(字|词|words?|word)"
PAGE_MARKER_PATTERN = r"\[(?:第\s*(\d+)\s*页|page\s*(\d+))\]"

# --- Fixed values: pillars, topics, KPIs, standards --------------------------------------------

PILLAR_LABELS = {"environment": "环境", "social": "社会", "governance": "治理"}
PILLAR_OWNERS = {
    "environment": "EHS / 环境管理",
    "social": "HR / 供应链 / 安全管理",
    "governance": "董事会办公室 / 合规",
}
DEFAULT_OWNER = "ESG 工作组"
STATUS_LABELS = {"covered": "已覆盖", "weak": "证据偏弱", "missing": "缺失"}
PILLAR_KEYWORDS = {
    "environment": [
        "environment", "环境", "climate", "气候", "emission", "排放", "scope 1", "scope 2", "scope 3", "能耗",
        "energy", "renewable", "可再生", "waste", "废弃物", "water", "水耗",
    ],
    "social": [
        "social", "社会", "员工", "employee", "training", "培训", "safety", "安全", "diversity", "多元", "women",
        "女性", "supplier", "供应商", "human rights", "人权", "community", "社区",
    ],
    "governance": [
        "governance", "治理", "board", "董事会", "committee", "委员会", "anti-bribery", "反舞弊", "anti-corruption",
        "反腐败", "compliance", "合规", "audit", "审计", "risk", "风控", "举报", "grievance",
    ],
}
# topic, label, pillar, keywords, required kinds, KPI patterns, weak evidence threshold
TOPICS = [
    ("gri_climate_emissions", "GRI 气候与排放", "environment",
     ["climate", "气候", "emission", "排放", "scope 1", "scope 2", "scope 3"], ["report"],
     ["scope 1", "scope 2", "scope 3", "tco2e", "排放"], 2),
    ("gri_energy_transition", "GRI 能源与转型", "environment",
     ["energy", "能耗", "renewable", "可再生", "electricity", "电力"], ["report"],
     ["可再生电力", "energy", "%"], 2),
    ("gri_workforce_development", "GRI 员工发展与培训", "social",
     ["employee", "员工", "training", "培训", "capability", "人才"], ["report"],
     ["培训覆盖率", "training coverage", "%"], 2),
    ("gri_supply_chain_rights", "GRI 供应链与人权", "social",
     ["supplier", "供应商", "human rights", "人权", "audit", "审核", "code of conduct"], ["contract", "report"],
     ["supplier audit", "供应商审核", "人权"], 2),
    ("gri_board_governance", "GRI 董事会与治理架构", "governance",
     ["board", "董事会", "committee", "委员会", "governance", "治理"], ["report"],
     ["committee met", "委员会会议", "board esg committee"], 2),
    ("gri_ethics_compliance", "GRI 商业道德与合规", "governance",
     ["anti-bribery", "反舞弊", "anti-corruption", "反腐败", "compliance", "合规", "ethics"], ["report"],
     ["anti-bribery training", "反舞弊培训", "%"], 2),
]
# metric, pillar, keywords, preferred units
KPIS = [
    ("可再生电力占比", "environment", ["可再生电力", "renewable electricity", "renewable power"], ["%"]),
    ("范围一排放", "environment", ["scope 1", "范围一"], ["吨", "tco2e", "kg", "万吨"]),
    ("范围二排放", "environment", ["scope 2", "范围二"], ["吨", "tco2e", "kg", "万吨", "%"]),
    ("范围三排放", "environment", ["scope 3", "范围三"], ["吨", "tco2e", "kg", "万吨"]),
    ("培训覆盖率", "social", ["培训覆盖率", "training coverage", "培训覆盖"], ["%"]),
    ("女性管理者占比", "social", ["女性管理者", "female manager", "women in management"], ["%"]),
    ("员工流失率", "social", ["离职率", "turnover rate", "attrition"], ["%"]),
    ("安全事故率", "social", ["安全事故", "injury rate", "ltifr"], ["%", "次"]),
    ("ESG 委员会会议次数", "governance", ["committee met", "委员会召开", "委员会会议", "board esg committee"], ["次"]),
    ("反舞弊培训覆盖率", "governance", ["anti-bribery training", "反舞弊培训", "anti-corruption training"], ["%"]),
    ("供应商审核数量", "social", ["supplier audit", "供应商审核", "supplier review"], ["家", "次", "个"]),
]
NUMBER_UNITS = r"%|次|家|人|吨|tco2e|万吨|kg|小时|项|个|times?|meetings?"
COUNT_UNIT_WORDS = ["times", "time", "meeting", "meetings"]
COUNT_UNIT = "次"
YEAR_RANGE = (1900, 2100)
KPI_EVIDENCE_CHARS = 220
TOPIC_SAMPLE_CHARS = 180
# code, name, priority, keywords; the first one always applies
STANDARDS = [
    ("GRI", "GRI Standards", 1, []),
    ("ISSB", "IFRS S1 / IFRS S2", 2,
     ["ifrs", "issb", "s1", "s2", "气候", "climate", "scope", "排放", "财务影响", "风险"]),
    ("ESRS", "European Sustainability Reporting Standards", 3,
     ["esrs", "csrd", "欧盟", "欧洲", "double materiality", "双重重要性"]),
    ("HKEX", "HKEX ESG Reporting Guide", 4, ["港交所", "hkex", "联交所"]),
    ("CN_EXCHANGE", "中国交易所可持续发展报告指引", 5, ["上交所", "深交所", "北交所", "可持续发展报告指引"]),
]
# related standard -> pillar it is limited to (None: every pillar)
RELATED_STANDARDS = {"ISSB": "environment", "ESRS": None, "HKEX": None, "CN_EXCHANGE": None}

# --- Fixed values: file types ------------------------------------------------------------------

IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "bmp", "gif", "webp", "tiff", "heic"]
EXCEL_SUFFIXES = ["xlsx", "xlsm", "xls"]
PRESENTATION_SUFFIXES = ["pptx"]
WORD_SUFFIXES = ["docx", "doc"]
EMAIL_SUFFIXES = ["eml", "msg"]
ARCHIVE_SUFFIXES = ["zip"]
NOTE_SUFFIXES = ["md", "markdown", "rst"]
TEXT_SUFFIXES = [
    "txt", "md", "markdown", "csv", "json", "jsonl", "xml", "html", "htm", "yaml", "yml", "ini", "cfg", "log", "sql",
    "py", "js", "ts", "tsx", "jsx", "css", "sh", "eml", "rst",
]
MAIL_HEADS = ["主题", "发件人", "收件人"]
TEXT_ENCODINGS = ["utf-8", "utf-8-sig", "gb18030", "big5", "shift_jis"]
FALLBACK_ENCODING = "latin-1"
PRINTABLE_SHARE = 0.85


# --- fixed wording of results -----------------------------------------------------------------
# Texts that results have to equal. Plain text, in the order of use.

REQUIRED_POLICY = "的政策、管理措施或年度进展"
REQUIRED_KPI = "相关 KPI、单位、期间和统计边界"
NEXT_ACTION = {
    "missing": ("补充", "的披露材料和量化数据。"),
    "weak": ("增强", "的证据数量、数据口径和管理措施说明。"),
    "incomplete": ("补齐", "的 KPI 口径或数据来源。"),
}
NEXT_ACTION_NONE = "当前披露证据较完整，可进入正文撰写和一致性检查。"
KPI_SUMMARY = ("共识别 ", " 个 ESG 指标：", "。")
KPI_SUMMARY_NONE = "当前材料中尚未识别到可直接抽取的 ESG 指标。"
NO_LOCATION = "正文定位未标注"
NO_DOCUMENT = "未命名文档"
SUMMARY_PILLARS = "ESG 材料覆盖："
SUMMARY_PILLAR_UNIT = " 份"
SUMMARY_TOPICS = "。GRI 主题矩阵："
SUMMARY_LOST = "待补齐："
OUTLINE_HEAD = ["# ESG 报告建议大纲", "## 1. 报告说明", "- 披露范围、边界、统计口径与时间区间", "- 关键假设、数据来源与第三方鉴证情况"]
OUTLINE_EMPTY_PILLAR = ("- 建议补充 ", " 相关披露主题与证明材料")
OUTLINE_KPIS = "## 关键指标附表"
RECOMMEND_PILLARS = "补充这些 ESG 支柱的材料："
RECOMMEND_KINDS = "建议优先补充这些文档类型："
RECOMMEND_KPIS = "当前材料中缺少清晰可提取的 ESG 指标，建议补充 KPI 表或量化段落。"
REPORT_HEADINGS = {"title": "# ESG 报告草稿", "about": "## 报告说明", "summary": "## 管理层摘要", "kpis": "## 关键绩效指标", "gaps": "## 数据缺口与后续动作", "evidence": "## 证据索引"}
REPORT_KPI_HEADER = "| 指标 | 数值 | 单位 | 来源 |"
ROLE_WARNINGS = {
    "no_source": "未能稳定识别源数据 workbook。",
    "no_template": "未能稳定识别待填模板 workbook。",
    "overlap": "源数据和模板角色存在重叠，后续会继续按候选单元格审计。",
    "low": "部分 workbook 角色置信度较低。",
}
LAYOUT_SUMMARY = ("识别表头位于第 ", " 行（", "）。", "工作表类型推断为 ", "。", "检测到 ", " 个标签锚点和 ", " 个候选值位。")
