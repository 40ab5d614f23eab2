"""Patterns and word lists that decide results. They are data, kept together and in their natural order."""

from __future__ import annotations

# Patterns of each parameter from the strictest to the loosest; the first group is the value.
PARAMETER_PATTERNS = {
    "VOH": [
        r"VOH\s+\S[^\n]*?\s([2-9]\.\d+|\d\d\.\d*)\s*V\b",
        r"V_?OH\s*[=:]\s*([+-]?\d+\.?\d*)\s*V",
        r"Output\s+High\s+Volt(?:age)?\s*[^\n]*?([2-9]\.\d+|\d\d\.\d*)\s*V",
        r"HIGH[- ]Level\s+Output\s+Volt[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VOH\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
    ],
    "VOL": [
        r"VOL\s+\S[^\n]*?\s(0\.\d+|[01]\.\d*)\s*V\b",
        r"V_?OL\s*[=:]\s*([+-]?\d+\.?\d*)\s*V",
        r"Output\s+Low\s+Volt(?:age)?\s*[^\n]*?(0\.\d+|[01]\.\d*)\s*V",
        r"LOW[- ]Level\s+Output\s+Volt[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VOL\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
    ],
    "VIH": [
        r"VIH\s+\S[^\n]*?\sMIN\s+([+-]?\d+\.?\d*)\s*V\b",
        r"VIH\s+\S[^\n]*?\smin\s+([+-]?\d+\.?\d*)\s*V\b",
        r"VIH\s+\S[^\n]*?\s([0-2]\.\d+)\s*V\b",
        r"V_?IH\s*[=:]\s*([+-]?\d+\.?\d*)\s*V",
        r"Input\s+High\s+Volt(?:age)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"HIGH[- ]Level\s+Input\s+Volt[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VIH\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
    ],
    "VIL": [
        r"VIL\s+\S[^\n]*?\sMAX\s+([+-]?\d+\.?\d*)\s*V\b",
        r"VIL\s+\S[^\n]*?\smax\s+([+-]?\d+\.?\d*)\s*V\b",
        r"VIL\s+\S[^\n]*?\s([0-1]\.\d+)\s*V\b",
        r"V_?IL\s*[=:]\s*([+-]?\d+\.?\d*)\s*V",
        r"Input\s+Low\s+Volt(?:age)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"LOW[- ]Level\s+Input\s+Volt[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VIL\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
    ],
    "IOH": [
        r"IOH\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*m?A\b",
        r"I_?OH\s*[=:]\s*([+-]?\d+\.?\d*)\s*m?A",
        r"Output\s+High\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
        r"IOH\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
    ],
    "IOL": [
        r"IOL\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*m?A\b",
        r"I_?OL\s*[=:]\s*([+-]?\d+\.?\d*)\s*m?A",
        r"Output\s+Low\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
        r"IOL\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
    ],
    "IIH": [
        r"IIH\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*[µuμ]?A\b",
        r"I_?IH\s*[=:]\s*([+-]?\d+\.?\d*)\s*[µuμ]?A",
        r"Input\s+High\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*[µuμ]?A",
        r"IIH\s*[^\n]*?([+-]?\d+\.?\d*)\s*[µuμ]?A",
    ],
    "IIL": [
        r"IIL\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*[µuμ]?A\b",
        r"I_?IL\s*[=:]\s*([+-]?\d+\.?\d*)\s*[µuμ]?A",
        r"Input\s+Low\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*[µuμ]?A",
        r"IIL\s*[^\n]*?([+-]?\d+\.?\d*)\s*[µuμ]?A",
    ],
    "VCC": [
        r"VCC\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*V\b",
        r"V_?CC\s*[=:]\s*([+-]?\d+\.?\d*)\s*V",
        r"Supply\s+Volt(?:age)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VCC\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VCC±\s*[=:]\s*±(\d+\.?\d*)\s*V",
        r"VCC\s*±\s*([+-]?\d+\.?\d*)\s*V",
        r"Supply\s+voltage\s+(?:range)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"Operating\s+voltage\s+(?:range)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
    ],
    "VDD": [
        r"VDD\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*V\b",
        r"V_?DD\s*[=:]\s*([+-]?\d+\.?\d*)\s*V",
        r"Supply\s+Volt(?:age)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VDD\s*[^\n]*?([+-]?\d+\.?\d*)\s*V",
        r"VDD±\s*[=:]\s*±(\d+\.?\d*)\s*V",
        r"VDD\s*±\s*([+-]?\d+\.?\d*)\s*V",
    ],
    "ICC": [
        r"ICC\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*m?A\b",
        r"I_?CC\s*[=:]\s*([+-]?\d+\.?\d*)\s*m?A",
        r"Supply\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
        r"Quiescent\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
        r"ICC\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
    ],
    "IDD": [
        r"IDD\s+\S[^\n]*?\s([+-]?\d+\.?\d*)\s*m?A\b",
        r"I_?DD\s*[=:]\s*([+-]?\d+\.?\d*)\s*m?A",
        r"Supply\s+Curr(?:ent)?\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
        r"IDD\s*[^\n]*?([+-]?\d+\.?\d*)\s*m?A",
    ],
}

# Pin lines in order of trust: pattern, group of the pin's number, group of its name.
PIN_LINES = [
    (r"(1IN\+|2IN\+|1IN-|2IN-|1OUT|2OUT|VCC\+|VCC-|GND|VEE|VSS|OUT1|OUT2)\s+(\d+)\s", 2, 1),
    (r"(\d+)\s+(1IN\+|2IN\+|1IN-|2IN-|1OUT|2OUT|VCC\+|VCC-|GND|VEE|VSS|OUT1|OUT2)\s", 1, 2),
    (r"Pin\s+(\d+)[:\s\-]+([A-Za-z][A-Za-z0-9_/-]{0,15})", 1, 2),
    (r"(\d+)\s*[-]\s*([A-Za-z][A-Za-z0-9_+/-]{0,15})\s*(?!\s*\d{4}\b)", 1, 2),
    (r"([A-Za-z][A-Za-z0-9_+/-]{0,15})\s*[-]\s*(\d+)", 2, 1),
    (r"(?m)^\s*(\d+)\s+([A-Za-z][A-Za-z0-9_+/-]{1,10})\s*$", 1, 2),
    (r"(\d+)\s+(GPIO\d+|[A-Za-z][A-Za-z0-9_+/-]{1,20})\s+(?:IO|电源|输入|输出|模拟|特殊)", 1, 2),
    (r"(\d+)\s+(GPIO\d+)\b", 1, 2),
    (r"(\d+)\s+([A-Z][A-Z0-9_]{1,20})\s+(?:VDD|VSS|IO|电源|GND)", 1, 2),
]

# Caption words by circuit type.
CIRCUIT_WORDS = [
    ("amplifier", ["amplifier", "op-amp", "opamp", "放大", "运放", "增益", "gain", "放大器", "放大电路", "信号放大", "功放", "差分", "differential", "反相", "inverting", "同相", "non-inverting", "反馈", "feedback", "电压跟随", "follower", "偏置", "bias", "ne5532", "lm358", "tl072", "lm741"]),
    ("filter", ["filter", "滤波", "低通", "高通", "带通", "lpf", "hpf", "bpf", "有源滤波", "sallen", "巴特沃斯", "butterworth", "陷波", "notch", "抗混叠", "anti-aliasing"]),
    ("oscillator", ["oscillator", "crystal", "hse", "hsi", "晶振", "振荡", "时钟", "clock", "vco", "压控振荡", "正弦波", "方波", "谐振", "resonant", "波形发生"]),
    ("power", ["power supply", "vdd", "vss", "vcc", "gnd", "regulator", "ldo", "dc-dc", "电源", "供电", "稳压", "接地", "ground", "去耦", "decoupling", "旁路", "bypass", "纹波", "ripple", "buck", "boost"]),
    ("rectifier", ["rectifier", "整流", "桥式", "半波", "全波", "二极管桥", "倍压"]),
    ("reset", ["reset", "nrst", "复位", "重启", "上电复位", "por", "看门狗", "watchdog"]),
    ("clock", ["clock", "timing", "clk", "时钟", "时钟分配", "clock buffer"]),
    ("driver", ["driver", "驱动", "电机驱动", "led驱动", "mosfet驱动", "h桥", "h-bridge", "pwm", "栅极驱动", "gate driver"]),
    ("comparator", ["comparator", "比较器", "lm393", "lm339", "阈值", "threshold", "迟滞", "hysteresis", "电压比较"]),
    ("timer", ["timer", "定时", "555", "ne555", "延时", "delay", "单稳态", "脉冲"]),
    ("protection", ["protection", "保护", "esd", "tvs", "过流", "overcurrent", "过压", "保险丝", "fuse", "限流", "浪涌", "surge"]),
    ("interface", ["interface", "接口", "uart", "spi", "i2c", "rs232", "rs485", "can", "usb", "电平转换", "收发器", "transceiver"]),
    ("sensor", ["sensor", "传感器", "检测", "测量", "温度", "压力", "光照", "霍尔", "热电偶", "信号采集", "变送器"]),
    ("regulator", ["regulator", "稳压", "ldo", "线性稳压", "开关稳压", "7805", "7812", "lm317", "tl431", "基准电压", "zener", "齐纳"]),
    ("buffer", ["buffer", "缓冲", "电压跟随器", "voltage follower", "单位增益", "阻抗变换", "线路驱动"]),
    ("logic", ["logic", "逻辑", "门电路", "gate", "触发器", "flip-flop", "cmos", "ttl"]),
    ("boot", ["boot", "startup", "启动", "引导", "bootstrap"]),
    ("decoupling", ["decoupling", "bypass", "去耦", "滤波电容", "旁路", "退耦"]),
    ("adc_dac", ["adc", "dac", "模数转换", "数模转换", "采样", "sampling", "参考电压", "reference"]),
    ("charge_pump", ["charge pump", "电荷泵", "电压反转", "倍压", "负电压"]),
    ("current_sense", ["current sense", "电流检测", "电流采样", "分流器", "shunt"]),
    ("emi_filter", ["emi", "emc", "共模电感", "磁珠", "ferrite", "噪声滤波", "电磁兼容"]),
    ("battery_mgmt", ["battery", "电池", "bms", "充电", "charging", "锂电池", "li-ion"]),
    ("pll", ["pll", "锁相环", "phase-locked", "频率合成", "鉴相器"]),
    ("sample_hold", ["sample and hold", "采样保持", "峰值检测", "模拟开关", "多路复用"]),
]

# Words that a figure query does not look for.
FIGURE_STOP_WORDS = (
    "的", "是", "在", "和", "与", "或", "及", "等", "中", "上", "下", "电路", "原理图", "schematic", "diagram", "circuit", "circuits",
    "图", "图片", "图像", "查找", "搜索", "检索", "显示", "给我", "一个", "这个", "那个", "什么", "如何", "怎么", "哪", "几",
    "请", "帮忙", "需要", "想要", "看看", "找", "要",
)
# What else a figure query looks for if one of its words holds the key, or the key the word.
FIGURE_SYNONYMS = {
    "放大": ["amplifier", "opamp", "运放", "gain", "增益", "放大器"],
    "滤波": ["filter", "低通", "高通", "带通", "LPF", "HPF", "BPF"],
    "电源": ["power", "供电", "稳压", "regulator", "LDO", "DC-DC"],
    "振荡": ["oscillator", "晶振", "crystal", "时钟", "clock"],
    "驱动": ["driver", "电机驱动", "LED驱动", "H桥", "PWM"],
    "比较": ["comparator", "比较器", "阈值", "threshold"],
    "定时": ["timer", "555", "延时", "delay"],
    "整流": ["rectifier", "桥式", "半波", "全波"],
    "保护": ["protection", "ESD", "TVS", "过流", "过压"],
    "接口": ["interface", "UART", "SPI", "I2C", "USB", "CAN"],
    "复位": ["reset", "POR", "看门狗", "watchdog"],
    "稳压": ["regulator", "LDO", "线性稳压", "开关稳压"],
}
# Names of a chip in queries and file names.
CHIP_SYNONYMS = {
    "ne5532": ["5532", "ne5532", "sa5532", "se5532"],
    "lm358": ["358", "lm358"],
    "tl072": ["072", "tl072"],
    "lm741": ["741", "lm741"],
    "lm324": ["324", "lm324"],
    "lm386": ["386", "lm386"],
    "555": ["555", "ne555", "lm555"],
    "lm317": ["317", "lm317"],
    "lm7805": ["7805", "lm7805"],
}
# Chips that a query is enriched for.
ENRICHED_CHIPS = (
    "ne5532", "lm358", "tl072", "lm741", "lm324", "lm386", "555", "lm317", "lm7805", "5532", "358", "072", "741", "324", "386", "317", "7805",
    "opa", "ad8605", "tl431", "tl082", "tl084", "opa2134", "ad823", "lt1013", "mc34063", "uc3842",
)
# Words that a query about a function is enriched with (the first three of each).
FUNCTION_WORDS = {
    "复位": ["reset", "POR", "NRST", "看门狗", "watchdog", "上电复位"],
    "启动": ["boot", "BOOT0", "引导", "bootstrap"],
    "滤波": ["filter", "LPF", "HPF", "BPF", "低通", "高通", "带通"],
    "电源": ["power", "LDO", "稳压", "regulator", "DC-DC", "供电"],
    "振荡": ["oscillator", "晶振", "crystal", "时钟", "clock", "VCO"],
    "放大": ["amplifier", "运放", "opamp", "gain", "增益"],
    "驱动": ["driver", "电机驱动", "LED驱动", "H桥", "PWM"],
    "转换": ["ADC", "DAC", "模数", "数模", "采样", "电平转换", "level"],
    "比较": ["comparator", "比较器", "阈值", "threshold"],
    "定时": ["timer", "555", "延时", "delay"],
    "接口": ["UART", "SPI", "I2C", "USB", "CAN", "串口"],
    "保护": ["ESD", "TVS", "保险丝", "过流", "过压"],
    "去耦": ["decoupling", "bypass", "旁路", "退耦"],
    "整流": ["rectifier", "桥式", "整流"],
    "逻辑": ["logic", "门电路", "触发器", "flip-flop"],
    "传感": ["sensor", "传感器", "温度", "压力"],
}

# Captions with two of these show no circuit.
NON_CIRCUIT_WORDS = (
    "package material", "package information", "tape and reel", "mechanical drawing", "outline dimension", "land pattern", "solder mask", "footprint", "pad layout",
    "board layout", "pcb layout", "physical dimension", "reel dimension", "cavity", "quadrant assignment", "pin 1 orientation", "spool hole", "pocket quadrant",
    "封装材料", "封装信息", "机械尺寸", "焊盘", "阻焊层", "pack materials page", "stencil", "solder paste", "paste example", "laser cutting",
    "aperture", "thickness", "based on", "scale example", "钢网", "焊膏", "开口", "锡膏", "example stencil", "small outline", "trapezoidal wall",
    "rounded corner", "assembly site", "revision history", "ordering information", "document history", "datasheet cover",
)

# Scan of flattened table text by parameter. Anchors in order; signs before and after an anchor; a mark inside that
# window with signs around it, if only these count; bounds of a number and whether its sign is read; where the first two go; unit.
TABLE_SCAN = {
    "VOH": (("HIGH-LEVEL", "HIGH LEVEL", "VOH", "OH"), 0, 500, ("OH", 50, 200), 2.0, 5.5, False, ("min", "typ"), "V"),
    "VOL": (("LOW-LEVEL", "LOW LEVEL", "VOL", "OL"), 0, 500, None, 0.0, 1.5, False, ("typ", "max"), "V"),
    "VIH": (("HIGH-LEVEL", "HIGH LEVEL", "VIH", "H-LEVEL"), 0, 500, None, 2.0, 4.0, False, ("min",), "V"),
    "VIL": (("LOW-LEVEL", "LOW LEVEL", "VIL", "L-LEVEL"), 0, 500, None, 0.0, 1.0, False, ("max",), "V"),
    "IOH": (("I OH", "IOH", "OH"), 100, 300, None, 1.0, 100.0, True, ("min",), "mA"),
    "IOL": (("I OL", "IOL", "OL"), 100, 300, None, 1.0, 100.0, True, ("min",), "mA"),
    "IIH": (("I IH", "IIH", "LEAKAGE"), 0, 300, None, 0.001, 100.0, False, ("min",), "µA"),
    "IIL": (("I IL", "IIL", "LEAKAGE"), 0, 300, None, 0.001, 100.0, False, ("min",), "µA"),
}

# Signs of LaTeX and of markup in a line.
LATEX_SIGNS = (
    r"\\begin{tabular}", r"\\end{tabular}", r"\\begin{table}", r"\\end{table}", r"\\hline", r"\\vline", r"\\cmidrule", r"\\toprule", r"\\bottomrule",
    r"\\multicolumn", r"\\multirow", r"\\text{", r"\\tag{", r"\\hspace", r"\\cmbox", r"\\vspace", r"\\hskip", r"\\tabular", r"\\begin", r"\\end",
    r"\&nbsp;", r"\&gt;", r"\&lt;", r"\\#", r"\\%", r"\\$", r"\\xspace", r"\\cmboxrule", r"rowspan={", r"num_rows", r"normalized_value", r"\tabs{}", r"\&",
)
# Lines that are always kept.
TECHNICAL_LINES = (
    r"VCC[±+-]?\s*[=：]\s*[±]?\d+\.?\d*\s*[Vv]?",
    r"VDD[±+-]?\s*[=：]\s*[±]?\d+\.?\d*\s*[Vv]?",
    r"VS[±+-]?\s*[=：]\s*[±]?\d+\.?\d*\s*[Vv]?",
    r"Supply\s+voltage[:\s]*[±]?\d+\.?\d*\s*[Vv]?",
    r"Operating\s+voltage[:\s]*[±]?\d+\.?\d*\s*[Vv]?",
    r"Electrical\s+Characteristics",
    r"Recommended\s+Operating\s+Conditions",
    r"Absolute\s+Maximum\s+Ratings",
    r"\bMIN\b.*\bMAX\b.*\bUNIT\b",
    r"\bPARAMETER\b.*\bTEST\s+CONDITIONS\b",
    r"\b\d+\.?\d*\s*V\b.*\b\d+\.?\d*\s*V\b",
)
# Numbers with units, a voltage first.
QUANTITIES = (r"[±]?\d+\.?\d*\s*V\b", r"[±]?\d+\.?\d*\s*[µunm]?A\b", r"\d+\.?\d*\s*[kM]?Ω?\b", r"\d+\.?\d*\s*[kMGT]?Hz\b", r"[±]?\d+\.?\d*\s*°?C\b")
# Headings of package drawings, and headings that end them.
PACKAGE_HEADINGS = ("seating plane", "pin 1 id area", "package dimensions", "mechanical data", "package information", "outline", "drawing", "dimensions (mm)", "inches", "millimeters", "package drawing", "mechanical drawing")
PACKAGE_ENDS = ("electrical characteristics", "recommended operating conditions", "absolute maximum ratings")
# Labels of axes, and titles of charts.
AXIS_LABELS = ("VDIFF (V)", "VIN (V)", "VOUT+ (V)", "VOUTt (V)", "VOUT- (V)", "Figure 7-2", "Figure 7-", "Figure 8-")
CHART_TITLES = ("Differential Output Voltage vs Input Voltage", "Positive Output Voltage Node vs Input Voltage", "Output Voltage")

# What a pin is for, in order: kind, words in its lower-case name, patterns at the start of its upper-case name.
PIN_KINDS = [
    ("power", ("vcc", "vdd", "power", "supply", "vee", "v+", "v-", "vbat", "vref", "vdda", "vssa", "avcc", "avdd", "dvcc", "dvdd", "vddio", "vout", "3v3", "5v", "1v8", "vin"), ()),
    ("ground", ("gnd", "vss", "ground", "pgnd", "agnd", "dgnd", "sgnd"), ()),
    ("special", ("nrst", "reset", "boot", "swdio", "swclk", "jtdi", "jtck", "jtms", "jtdo", "jtrst", "trst", "tck", "tms", "tdi", "tdo", "test", "mode", "por", "wdt"), ()),
    ("special", ("xtal", "osc", "clk", "clkout", "mco", "hse", "hsi", "lse", "lsi"), ()),
    ("output", ("out",), (r"^\d*(?:OUT|O)\d*$",)),
    ("input", ("input", "in+", "in-", "_i", "+", "-"), (r"^\d*(?:IN|I)[N\d]*[+-]?$",)),
    ("nc", ("nc", "n.c.", "no connect", "n/a", "dnc", "reserved"), ()),
    ("analog", ("adc", "dac", "analog", "aout", "ain"), ()),
    ("bidirectional", (), (r"^P[A-Z]\d+", r"^[A-E]\d+", r"^GP\d+", r"^IO\d+", r"^RB\d+", r"^RC\d+", r"^RD\d+", r"^RA\d+", r"^GPIO\d*")),
]
OTHER_PIN = "io"

# Names that tell what a pin is for: words in the lower-case name, patterns of the upper-case name.
MEANINGFUL_WORDS = (
    "input", "output", "in+", "in-", "out+", "out-", "out1", "out2", "in1", "in2", "reset", "nrst",
    "boot", "xtal", "osc", "clk", "adc", "dac", "swdio", "swclk", "mco", "in", "out",
)
MEANINGFUL_PREFIXES = ("VCC", "VEE", "VDD", "VSS", "GND", "V+", "V-", "VBAT", "VREF", "VDDA", "VSSA", "AVCC", "AVDD")
MEANINGFUL_PATTERNS = (r"^P[A-Z]\d+", r"^[A-E]\d+", r"^GP\d+")

# What looks like a pin's name and is none; months count only together with a year or a number after a dash.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DATE_PATTERNS = (r"\d{4}", r"-\d+")
GARBAGE_PATTERNS = (
    r"^(?:REV|REVISION|VERSION|VER|V\d*\.?\d*)$",
    r"^PAGE\s*\d+$",
    r"^\d{4}$",
    r"^[A-Z]{3}-\d{4}$",
    r"^DOC(?:UMENT)?\s*\d*$",
    r"^SHEET\s*\d+/\d+$",
    r"^(?:WWW\.|HTTP|HTTPS|@)",
    r"^\d+\s*[\/\-\.]\s*\d+\s*[\/\-\.]\s*\d+$",
    r"^FIGURE\s*\d+|^TABLE\s*\d+",
    r"^(?:CONFIDENTIAL|PROPRIETARY|DRAFT|PRELIMINARY)$",
)

# Words of which two make a figure a circuit, and class labels that pass or are rejected.
CIRCUIT_EVIDENCE = ("circuit", "schematic", "amplifier", "filter", "regulator", "oscillator", "op-amp", "transistor", "capacitor", "resistor", "电路", "原理图", "放大器", "滤波器", "稳压器", "振荡器")
PASSED_CLASSES = ("circuit_diagram", "application_circuit", "test_circuit", "block_diagram", "schema")
REJECTED_CLASSES = ("chip_package", "pin_diagram", "pcb_layout", "mechanical_drawing", "package_materials", "table", "chart", "timing_diagram", "logo", "photo", "truth_table", "state_diagram", "pinout_diagram", "other")

# Part numbers and component values in a caption, in order; of each the first five count.
COMPONENT_PATTERNS = (r"\b([A-Z]{2,}\d{2,}[A-Z0-9]*)\b", r"\b(LM\d{3,}|NE\d{3,}|TL\d{3,}|AD\d{3,}|OPA\d{3,})\b", r"\b(\d{1,4}[kKmM]?[Ωω])", r"\b(\d{1,4}[pPnNuUμmM]?[Ff])\b")

# Packages in the order in which they are looked for.
PACKAGES = ("DIP", "SOIC", "TSSOP", "SSOP", "QFN", "QFP", "PLCC", "LGA", "BGA", "SOP", "SOT", "TO")

# Part numbers of drivers and receivers.
PAIRED_PARTS = r"(SN74[A-Z]{0,3}\d+[A-Z0-9-]*|74[A-Z]{1,3}\d+[A-Z0-9-]*|(?:NE|LM|CD|MAX|MCP|PCA|PCF|ADS|OP|TL)\d+[A-Z0-9]*)"

# What a section is searched for by the kind of a question, and otherwise.
SECTION_VALUES = {
    "voltage": r"((?:VCC|VDD|VS|Supply\s+voltage)[^\n]{0,40}?\d+\.?\d*\s*V)",
    "current": r"((?:ICC|IDD|Supply\s+current)[^\n]{0,40}?\d+\.?\d*\s*m?A)",
    "temperature": r"((?:Operating\s+temperature|TA)[^\n]{0,40}?-?\d+\s*°?C)",
}
OTHER_SECTION_VALUE = r"((?:Power\s+dissipation|PD)[^\n]{0,40}?\d+\.?\d*\s*m?W)"

# Words that stay in a rewritten query.
REWRITE_WORDS = ("voltage", "vcc", "vdd", "supply", "current", "power", "temperature", "operating", "frequency", "bandwidth")

# Classes of captions and their keywords, which are looked for as they stand in a lower-case text.
CAPTION_CLASS_WORDS = {
    "amplifier": ["amplifier", "op-amp", "运放", "增益", "gain", "反馈", "feedback"],
    "filter": ["filter", "滤波", "低通", "高通", "带通", "LPF", "HPF", "BPF"],
    "power": ["power", "电源", "稳压", "regulator", "LDO", "DC-DC", "供电"],
    "oscillator": ["oscillator", "振荡", "晶振", "crystal", "时钟", "clock"],
    "driver": ["driver", "驱动", "LED驱动", "电机驱动", "H桥", "PWM"],
    "comparator": ["comparator", "比较器", "阈值", "threshold"],
    "timer": ["timer", "定时", "555", "延时", "delay"],
    "rectifier": ["rectifier", "整流", "桥式", "半波", "全波"],
    "protection": ["protection", "保护", "ESD", "TVS", "过流", "过压"],
    "interface": ["interface", "接口", "UART", "SPI", "I2C", "USB", "CAN"],
    "reset": ["reset", "复位", "POR", "看门狗", "watchdog"],
    "logic": ["logic", "逻辑", "门电路", "触发器", "flip-flop"],
}
# Names of chips that raise the rank of a figure.
RANKED_CHIPS = (
    "ne5532", "lm358", "tl072", "lm741", "lm324", "opa", "ad8605",
    "5532", "358", "072", "741", "324", "555", "386", "317", "7805",
    "tl431", "tl082", "tl084", "opa2134", "ad823", "lt1013",
    "mc34063", "uc3842",
)

# Preambles of thinking, in the order in which they are tried.
THINKING_PREFIXES = (
    r"\d*\s*Thinking\s*Process\s*:\s*",
    r"\d*\s*Analyze\s+the\s+Request\s*:\s*",
    r"\d*\s*Let(?:'s|\s+me)\s+(?:think|analyze|reason|break\s+down)\s*[:：]?\s*",
    r"\d*\s*Step\s*\d+\s*[:：]\s*Analysis\s*",
)
# What an answer begins with.
ANSWER_START = (
    r"(?:(?:NE|LM|SN|CD|STM32?|AD|MAX|TL|OP|UA|MC|AT)[\p{L}\p{N}_]*(?:的|是|工作|电源|电压|供电|输入|输出|最大|最小|范围|绝对)"
    r"|根据[^\n]*?(?:规格|数据|资料|文档|手册)"
    r"|[±]?\d+\.?\d*\s*[VvAa][\s，,。.；;]"
    r"|该(?:芯片|器件|元件)"
    r"|Supply\s+voltage)"
)
# What goes out of an answer, or is written another way, in this order.
ANSWER_REPLACEMENTS = (
    (r"(?i)^(?:Wait|Oh\s+wait|Let\s+me\s+think|I\s+need\s+to)[,.]?\s+", ""),
    (r"^\d+\s+(?=[A-Za-z一-鿿])", ""),
    (r"^[\n*\-. ]+", ""),
    (r"\*\*", ""),
    (r"<[^>]+>", ""),
    (r"```markdown\s*", ""),
    (r"```\s*", ""),
    (r"(?im)^\s*(?:Solution|Answer|Result)\s*[:：]?\s*$", ""),
    (r"(?is)根据.*?分析如下：", ""),
    (r"(?i)作为[^。！？]+专家[^。！？]*[，,。！？]", ""),
    (r"(?i)我需基于[^。！？]+[。！？]", ""),
    (r"(?i)以下是针对[^。！？]+[：:]", ""),
    (r"(\d+)\.\s+(\d+)", "$1.$2"),
    (r"(\d+)\.\n(\d+)", "$1.$2"),
    (r"(?i)(\d+)\s+(V|A|℃|°C|mA|mV|μA|kHz|MHz)", "$1$2"),
    (r"(?i)(\d+)\.\s*(V|A|℃|°C|mA|mV|μA|kHz|MHz)", "$1$2"),
)
