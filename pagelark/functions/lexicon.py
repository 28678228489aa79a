"""Phrase groups of the evidence search."""

from __future__ import annotations

# The phrases of each group, as the document language has them.
CASH = (
    "现金及现金等价物", "现金和现金等价物", "现金及银行结余", "银行结余及现金", "现金流量表所述现金及现金等价物",
    "現金及現金等價物", "現金及現金等值物", "現金及銀行結餘", "銀行結餘及現金", "現金流量表所述現金及現金等價物",
    "cash and cash equivalents", "cash equivalents", "cash and bank balances", "bank balances and cash",
    "cash and cash equivalent", "cash and bank balance",
)
ENDING_CASH = (
    "现金流量表期末现金及现金等价物", "年末现金及现金等价物", "期末现金及现金等价物", "年末之现金及现金等价物",
    "期末之现金及现金等价物", "于年末的现金及现金等价物", "年期末的现金及现金等价物", "于年期末的现金及现金等价物",
    "于期末的现金及现金等价物", "现金及现金等价物期末余额", "现金及现金等价物的期末结余",
    "現金流量表期末現金及現金等價物", "年末現金及現金等價物", "期末現金及現金等價物", "年末之現金及現金等價物",
    "期末之現金及現金等價物", "於年末的現金及現金等價物", "年期末的現金及現金等價物", "於年期末的現金及現金等價物",
    "於期末的現金及現金等價物", "現金及現金等價物期末結餘", "現金及現金等價物的期末結餘",
    "cash and cash equivalents at end of year", "cash and cash equivalents at the end of year",
    "cash and cash equivalents at end of period", "cash and cash equivalents at the end of period",
    "cash and cash equivalents at the end of the reporting period",
    "cash and cash equivalents as stated in the statement of cash flows",
)
CASH_BALANCE = (
    "现金余额", "现金及现金等价物余额", "現金結餘", "現金及現金等價物結餘", "cash balance", "cash and cash equivalents balance",
)
OPERATING_CASH_FLOW = (
    "经营活动所用净现金流量", "经营活动产生的净现金流量", "经营活动所用现金净额", "经营活动产生的现金净额",
    "经营活动产生所用现金流量净额", "经营活动所用所得现金净额", "经营活动所得所用现金净额", "经营活动所用所得现金",
    "经营活动所得所用现金", "经营活动所产生的现金净额", "经营活动所得现金净额", "经营活动现金流", "经营活动所用现金",
    "經營活動所用淨現金流量", "經營活動產生的淨現金流量", "經營活動所用現金淨額", "經營活動產生的現金淨額",
    "經營活動現金流", "經營活動所用現金", "經營活動產生所用現金流量淨額", "經營活動所用所得現金淨額",
    "經營活動所得所用現金淨額", "經營活動所用所得現金", "經營活動所得所用現金", "經營活動所產生的現金淨額",
    "經營活動所得現金淨額", "經營業務所用現金", "net cash used in operating activities",
    "net cash generated from operating activities", "operating cash flow", "cash flows from operating activities",
    "net operating cash flow",
)
STATEMENT_TITLES = (
    "綜合現金流量表", "综合现金流量表", "合併現金流量表", "合并现金流量表", "現金流量表", "现金流量表",
    "statement of cash flows", "consolidated statement of cash flows", "consolidated cash flow statement",
    "combined statement of cash flows",
)
FINANCIAL = (*STATEMENT_TITLES, "會計師報告", "会计师报告", "财务资料", "財務資料", "人民币千元", "人民幣千元")
NEGATIVE = ("主要法律及監管規定概要", "组织章程细则", "組織章程細則概要", "清算", "股东权利", "股東權利")
RECONCILIATION = ("現金流量表所述現金及現金等價物", "现金流量表所述现金及现金等价物")
AUDITED = (
    "附錄一", "附录一", "會計師報告", "会计师报告", "歷史財務資料", "历史财务资料", "accountants' report",
    "accountants’ report", "historical financial information",
)
SUMMARY = (
    "概要", "摘要", "財務資料概要", "财务资料摘要", "財務資料概覽", "财务资料概览", "流動資金及資本資源",
    "流动资金及资本资源", "風險因素", "风险因素",
)
NOTES = (
    "會計政策", "会计政策", "主要會計政策", "主要会计政策", "信用風險", "信用风险", "流動資金風險", "流动资金风险",
    "現金及銀行結餘", "现金及银行结余", "借款",
)
BEGINNING_CASH = (
    "年初現金及現金等價物", "期初現金及現金等價物", "於年初的現金及現金等價物", "年初现金及现金等价物",
    "期初现金及现金等价物", "于年初的现金及现金等价物", "cash and cash equivalents at beginning of year",
    "cash and cash equivalents at beginning of period",
)
CASH_CHANGE = (
    "現金及現金等價物增加", "現金及現金等價物減少", "現金及現金等價物的淨增加", "现金及现金等价物增加",
    "现金及现金等价物减少", "现金及现金等价物净增加", "net increase in cash and cash equivalents",
    "net decrease in cash and cash equivalents",
)
EXCHANGE_EFFECT = (
    "匯率變動對現金及現金等價物", "現金及現金等價物的匯率變動", "現金及現金等價物的匯兌", "汇率变动对现金及现金等价物",
    "现金及现金等价物的汇率变动", "现金及现金等价物的汇兑", "effect of exchange rate changes on cash and cash equivalents",
    "exchange differences on cash and cash equivalents",
)
TABLE_UNITS = ("人民币千元", "人民幣千元", "港币千元", "港幣千元", "rmb'000", "hk$'000", "usd'000")
BROAD = ("经营活动", "經營活動", "operating", "activities", "cash")

#: Intents in the order in which a query is tried against them, with the aliases that then search beside the query.
INTENTS = (
    ("cash_flow_ending_cash", ENDING_CASH, (*ENDING_CASH, *CASH)),
    ("cash_balance", CASH_BALANCE, CASH_BALANCE),
    ("cash_and_cash_equivalents", CASH, CASH),
    ("operating_cash_flow", OPERATING_CASH_FLOW, OPERATING_CASH_FLOW),
)
GENERIC = "generic_keyword"

# Row labels, by priority.
CASH_LABELS = (
    r"現金流量表所述現金及現金等價物",
    r"现金流量表所述现金及现金等价物",
    r"(?:年末|期末|於年末|於期末).*?現金及現金等價物",
    r"(?:年末|期末|于年末|于期末).*?现金及现金等价物",
    r"(?i)cash and cash equivalents (?:at|as at) (?:the )?end of (?:the )?(?:year|period)",
    r"(?i)cash and cash equivalents as stated in the statement of cash flows",
)
OPERATING_LABELS = (
    r"經營活動(?:所用|所得|產生|使用)?(?:之)?淨現金(?:流量)?",
    r"经营活动(?:所用|所得|产生|使用)?(?:之)?净现金(?:流量)?",
    r"(?i)net cash (?:used in|generated from|from) operating activities",
    r"(?i)net cash flows? (?:used in|generated from) operating activities",
)
