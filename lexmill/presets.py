"""Legal presets: word lists and boundaries as data. Every operator takes its own through parameters.

Fixed values: the lists and patterns below are domain vocabulary whose members must be exactly these for equal results.
"""

from dataclasses import dataclass

PENALTIES = ["fixed_term", "detention", "control", "life", "death", "exempt", "unknown"]
SPLIT_PRIORITY = {"train": 0, "valid": 1, "test": 2}
SENTENCE_BINS = [(6, "fixed_term_0_6"), (12, "fixed_term_7_12"), (24, "fixed_term_13_24"), (36, "fixed_term_25_36"), (60, "fixed_term_37_60"), (120, "fixed_term_61_120")]
SENTENCE_TOP = "fixed_term_121_plus"
LENGTH_BUCKETS = [(512, "lt_512"), (1024, "512_to_1023"), (2048, "1024_to_2047"), (4096, "2048_to_4095")]
LENGTH_TOP = "ge_4096"
AMOUNT_EDGES = [1000.0, 2000.0, 3000.0, 5000.0, 6000.0, 10000.0, 20000.0, 30000.0, 50000.0, 60000.0, 100000.0, 200000.0, 300000.0, 400000.0, 500000.0, 1000000.0, 3000000.0, 5000000.0]
TARGET_CONDUCT = {"盗窃": "秘密窃取", "诈骗": "虚构事实使被害人自愿交付", "赌博": "参与赌博", "开设赌场": "组织并经营赌博场所", "故意伤害": "因个人纠纷定向伤害", "寻衅滋事": "无事生非随意殴打", "抢夺": "趁人不备公开夺取", "抢劫": "暴力胁迫取财"}
MASK = "[已屏蔽]"

NEGATIONS = ["尚未", "未能", "拒不", "没有", "并未", "未", "不", "无"]
NEGATION_GAPS = ["", "主动", "如实", "全部", "完全", "及时", "积极", "当庭", "彻底", "足额", "全额", "予以", "进行", "马上", "立即"]
ABSORBED = ["不但", "不仅", "不只", "不光", "不单", "不过", "不论", "不管", "未成年", "未满", "未婚", "无前科", "无犯罪前科"]
SURRENDER = ["投案自首", "主动投案", "构成自首", "自首"]
RESTITUTION = ["返还赃款", "退赃", "退赔"]
CONFESSION = ["如实供述", "坦白", "认罪"]
CONDUCT = [
    ("秘密窃取", ["秘密窃取", "盗走", "偷走", "窃得", "窃取", "扒窃", "盗取"]),
    ("虚构事实使被害人自愿交付", ["虚构事实", "隐瞒真相", "骗取", "谎称", "冒充"]),
    ("组织并经营赌博场所", ["组织赌博", "抽头渔利", "抽头", "抽水", "提供赌博场所"]),
    ("参与赌博", ["参与赌博", "聚众赌博", "参赌"]),
    ("暴力胁迫取财", ["持刀威胁", "劫取", "以暴力相威胁", "强行劫走", "胁迫交付"]),
    ("趁人不备公开夺取", ["趁人不备", "乘人不备", "夺走", "夺取"]),
    ("无事生非随意殴打", ["无事生非", "借故生非", "随意殴打"]),
    ("因个人纠纷定向伤害", ["个人纠纷", "因琐事", "发生纠纷", "致人轻伤", "致其轻伤", "轻伤一级", "轻伤二级", "重伤一级", "重伤二级"]),
]
AMOUNT = r"(?:涉案(?:金额)?|价值|获利|金额)[^0-9，。；]{0,12}?([0-9][0-9,，]*(?:\.[0-9]+)?)\s*(万)?元"
ANY_AMOUNT = r"([0-9][0-9,，]*(?:\.[0-9]+)?)\s*(万)?元"

RESULT_STATEMENT = "(?:公诉机关|人民检察院|检察院)指控"
STRONG_CONCLUSION = (
    "(?:公诉机关|检察院|检察机关|公诉人)认为|本院认为|(?<!根)据此|综上|追究其?刑事责任|提请(?:本院|法院|依法)|量刑建议"
    "|建议(?=[^。；！？\\n]{0,40}?(?:判|量刑|幅度|刑|罪|撤销|并罚|拘役|管制|缓刑|罚金|[一二三四五六七八九十两0-9]+(?:年|个月)))"
    "|(?:依据|依照|根据)《|(?:应当以|(?<!答)应以)"
)
WEAK_CONCLUSION = "其(?:上述)?行为已?(?:触犯|构成)|依法(?:惩处|判处|处罚|追究)|(?<!不)(?:可以|应当|应|酌情)(?:依法)?(?:从轻|从重|减轻|加重|从宽|从严)(?:、(?:从轻|从重|减轻|加重|从宽|从严))*处罚"
HISTORY = "(?:曾|以前|此前|当年|前科)"
NUMERAL = "[一二三四五六七八九十百千零〇两0-9]+"
ARTICLE = f"(?:《[^》]{{0,30}}》|刑法)?第{NUMERAL}条(?:之{NUMERAL})?(?:第{NUMERAL}款)?(?:第{NUMERAL}项)?|第{NUMERAL}款"
# Fixed value. The cue stands in a look-behind, so that the match is the charge alone.
CUED_CHARGE = "(?<=(?:犯|构成|涉嫌|触犯|应当以|(?<!答)应以))[一-龥、]{2,12}?(?<![认悔无有获得])罪"
# A charge's mention, and a heading such as "一、" before it. NAME stands for any name of a lexicon.
MENTIONS = ["NAME(?:犯罪|罪|案)", "(?<=[一二三四五六七八九十]、)NAME(?=[；：:，。\\n])"]


@dataclass(frozen=True)
class Rules:
    """Patterns of redaction; stops end a sentence, pauses a clause, weak markers don't count after history in their clause."""

    statement: str
    strong: str
    weak: str
    history: str
    article: str
    cued: str
    mentions: tuple[str, ...]
    stops: str
    pauses: str
    mask: str = MASK


LEGAL = Rules(RESULT_STATEMENT, STRONG_CONCLUSION, WEAK_CONCLUSION, HISTORY, ARTICLE, CUED_CHARGE, tuple(MENTIONS), stops="。；！？\\n", pauses="，,、")
LEAKS = ["label_leakage", "target_label_leakage", "article_leakage", "conclusion_leakage", "sentence_leakage", "mask_restored"]

TAKING = ["盗得", "窃得", "骗得", "抢得", "夺取", "夺走", "劫取", "劫走", "强行劫走", "盗走", "偷走", "窃取", "盗取", "扒窃", "骗取", "秘密窃取", "趁人不备", "乘人不备", "持刀威胁", "以暴力相威胁", "胁迫交付"]
DISCRIMINATORS = {"因个人纠纷定向伤害": ["个人纠纷", "因琐事", "发生纠纷", "因琐事与"], "无事生非随意殴打": ["无事生非", "借故生非", "随意殴打", "无故殴打"]}
VERBS = {
    **{k: v for k, v in CONDUCT if k in ("组织并经营赌博场所", "参与赌博")}, **DISCRIMINATORS,
    "秘密窃取": TAKING, "趁人不备公开夺取": TAKING, "暴力胁迫取财": TAKING, "虚构事实使被害人自愿交付": [*TAKING, "虚构事实", "隐瞒真相", "谎称", "冒充"],
}
SUMMARIES = ["共参与", "共实施", "共同作案", "作案", "总计", "总价值", "共计作案"]
INITIAL_VERBS = "破进将趁因持驾开负把抓在到殴打盗窃夺抢骗敲望放接"
CUED_AMOUNT = r"(?:涉案(?:金额)?|价值|获利|金额|数额|共计)[^0-9，。；]{0,8}?([0-9][0-9,，]*(?:\.[0-9]+)?)\s*(万)?元"
PENALTY_TALK = "有期徒刑|拘役|管制(?!刀具)|缓刑|罚金|死刑|无期|从轻|减轻|从重|免予刑事处罚|判处|刑期"
MASKS = ["××", MASK]
# Every match of the pattern holds one of the words, so that texts without any need no search.
CONCLUSION_WORDS = ["认为", "据此", "综上", "刑事责任", "提请", "建议", "依据", "依照", "根据", "应当以", "应以", "行为", "依法", "处罚"]
NEEDED = {
    AMOUNT: ["元"], ANY_AMOUNT: ["元"], CUED_AMOUNT: ["元"], CUED_CHARGE: ["罪"], ARTICLE: ["条", "款"], RESULT_STATEMENT: ["指控"],
    PENALTY_TALK: ["有期徒刑", "拘役", "管制", "缓刑", "罚金", "死刑", "无期", "从轻", "减轻", "从重", "免予刑事处罚", "判处", "刑期"],
}
RESTITUTION_CLAUSE = {True: "案发后已退赃退赔", False: "案发后未退赃退赔"}

# The experiments by name; "from" takes another's settings first.
EXPERIMENT_BASE = {
    "backbone": "qwen35", "use_factors": False, "ordinary_augmentation": False, "typed_counterfactuals": False, "use_invariant": False, "use_boundary": False, "use_rank": False,
    "hard_charge_sentence": False, "filter_counterfactuals": True,
}
EXPERIMENTS = {
    "B0": {"backbone": "majority_mean"}, "B1": {"backbone": "hfl/chinese-roberta-wwm-ext"}, "B2": {"backbone": "thunlp/Lawformer"}, "B3": {},
    "B4": {"use_factors": True}, "B5": {"use_factors": True, "ordinary_augmentation": True},
    "M": {"use_factors": True, "typed_counterfactuals": True, "use_invariant": True, "use_boundary": True, "use_rank": True},
    "A1": {"from": "M", "use_invariant": False}, "A2": {"from": "M", "use_boundary": False}, "A3": {"from": "M", "use_rank": False},
    "A4": {"from": "M", "use_factors": False}, "A5": {"from": "M", "hard_charge_sentence": True}, "A6": {"from": "M", "filter_counterfactuals": False},
}
