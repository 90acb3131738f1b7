"""Personal information inside free text: a semi-Markov conditional random field over candidate segments.

Whole spans are scored: a segment of a kind (email, phone, id_number, address, name) gets the sum of the weights of
features of the span and its surroundings; text outside segments scores 0. Candidates of bounded length come from
the shape of what a kind can look like at all; a dynamic programme over a text's candidates, which may overlap in any
way, chooses boundaries and kinds jointly. The weights maximise the conditional likelihood of labelled lines that
:func:`labelled_lines` makes by rule (``TRAINING_LINES`` of them, the only sample), with the same lattices.

What is found in a text depends on that text alone: nothing is counted over other rows. How ordinary a word is
enters as a feature, from three sources: lists of function words, whether its lower-case form is one token of a public
tokenizer's vocabulary (a fixed sample of what text is made of), and whether the text itself has it in lower case.

A name has two to ``PARTS`` parts (words, initials, particles such as "van der"), in any script with capitals; in Han,
kana, Arabic, Devanagari and Thai it starts with a common family name or follows a word that introduces a person. In
lower case it is a candidate where both words are outside the vocabulary, or after such a word.

Patterns read the shadow of :mod:`sentences` (width forms, look-alikes and invisible characters resolved); spans are
code-point offsets of the text as stored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
import os
import random
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.bpe import VOCABULARIES
from inkfathom.llm.sentences import shadow

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
TRAINING_LINES, EPOCHS = 6000, 5
#: A name has at most this many parts.
PARTS = 7
#: Vocabularies whose single tokens count as ordinary words.
WORD_TOKENS = ("byte_bpe_50k", "byte_bpe_multi_50k")

AT, DOT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)", r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
EMAIL = regex.compile(rf"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*{AT}[a-z0-9-]+(?:{DOT}[a-z0-9-]+)*{DOT}[a-z]{{2,}}(?![a-z0-9-]|\+|\s?@|\s?[\[({{]\s?at\b|\sat\s)")
EMAIL_CUE = re.compile(r"@|[\s\[({][aA][tT][\])}\s]\s?[A-Za-z0-9-]+(?:\.[A-Za-z]|\s?[\[({]?\s?[dD][oO][tT][\s\])}])")
#: Cheap tests that each candidate of the slower patterns passes.
NUMBER_CUE = re.compile(r"\d(?:[A-Z .\-/()]{0,3}\d){5}")
STREET_CUES = ("alle", "laza", "aseo", "amino", "vda", "venida", "onda", "C/", "c/", "gasse", "weg", "straße", "strasse", "str.", "platz", "allee", "ufer", "damm", "ring ", "steig", "pfad", "Am ", "An der ", "Im ", "Zum ", "Zur ", "Auf de", "Unter den ", "Alte", "Neue ", "Große ")
OTHER_STREET_CUES = ("ул", "пр", "пер", "шоссе", "наб", "号", "丁目", "番", "市", "区", "شارع", "طريق", "मार्ग", "नगर", "रोड", "गली", "ถนน", "ซอย", "ตำบล")
NUMBER = regex.compile(r"(?<![\p{Nd}A-Za-z])(?:\+\s?|\((?=\d))?(?:[A-Z]{1,3}[- ]?)?\d(?:[A-Z](?=\d)|[ .\-/()]{0,2}\d)*(?:-?[A-Z](?![A-Za-z])|(?<=[A-Z]{2} \d\d \d\d \d\d) [A-Z](?![A-Za-z]))?(?!\p{Nd})(?![A-Za-z])")
_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Crescent|Row|Hill|Park"
_CAP = r"\p{Lu}[\p{L}'’.-]*"
#: A word of a town; only a few short ones carry a full stop.
_TOWN = r"(?:(?:St|Mt|Ft|Ste)\.|\p{Lu}[\p{L}'’-]*\p{L})"
UNIT = r"(?:,? (?:Apt|Unit|Flat|Suite|Ste|No|Room|Apartment|Floor)\.? ?\d*[A-Z]?\d*|,? ?#\d+[A-Z]?|, \d+\.?º(?: [A-Z](?!\p{L}))?|, \d+\. Stock)"
TOWN = rf"(?:, (?:\d{{4,6}} )?{_TOWN}(?:[ -](?:{_TOWN}|sur|de|del|la|am|an|der))*(?:, [A-Z]{{2}})?(?: \d{{4,6}})?)"
STREETS_BY_NUMBER = regex.compile(
    rf"(?<![\p{{L}}\p{{Nd}}])(?:\d{{1,5}}[a-zA-Z]?(?: bis)? (?:{_CAP} ){{1,3}}(?:{_EN})\b\.?(?=[\s,.;)!?]|$)"
    rf"|\d{{1,5}}(?: bis| ter)?,? (?:rue|bd|boulevard|avenue|av\.|place|chemin|quai|impasse|allée) (?:(?:de|du|des|la|le|les) |de l')*{_CAP})"
)
STREETS_BY_NAME = regex.compile(
    rf"(?<![\p{{L}}\p{{Nd}}])(?:(?:calle|plaza|paseo|camino|avda\.|avenida|ronda|c/|C/|Calle|Plaza|Avenida|Avda\.) ?(?:(?:de|del|la|las|los|el) )*{_CAP}(?: {_CAP})*,? (?:n\.?º ?|núm\. )?\d{{1,5}}"
    rf"|(?:\p{{Lu}}[\p{{L}}-]*(?:gasse|weg|straße|strasse|str\.|platz|allee|ufer|damm|ring|steig|pfad)|(?:Am|An der|Im|Zum|Zur|Auf der|Auf dem|Unter den|Alte|Alter|Neue|Große) {_CAP}(?: {_CAP})?) \d{{1,4}}[a-z]?(?!\d|\.\d|\p{{L}}))"
)
#: Russian, Chinese, Japanese, Arabic, Hindi and Thai forms; the house number is part of each.
OTHER_STREETS = regex.compile(
    r"(?:ул(?:\.|ица)|пр(?:-т|осп?\.|оспект)|пер(?:\.|еулок)|шоссе|наб(?:\.|ережная)) ?\p{Lu}[\p{L}-]*(?: \p{Lu}[\p{L}-]*)?,? (?:д(?:\.|ом) ?)?\d{1,4}[а-я]?(?:,? (?:корп|к|стр)\.? ?\d+)?(?:,? кв(?:\.|артира) ?\d+)?"
    r"|(?:[\p{Han}]{2,8}(?:省|市|区|县|镇))*[\p{Han}]{1,8}(?:路|街|大道|巷|胡同|弄)\d{1,5}(?:号|號)(?:[\p{Han}]{0,6}\d{1,4}(?:室|楼|栋|单元|号))*"
    r"|[\p{Han}]{2,3}[都道府県][\p{Han}\p{Hiragana}\p{Katakana}ー]{1,12}[市区町村][\p{Han}\p{Hiragana}\p{Katakana}ー]{0,10}\d{1,4}(?:丁目\d{1,4}番(?:地)?(?:\d{1,4}号)?|(?:-\d{1,4}){1,3})"
    r"|(?:\d{1,5} )?(?:شارع|طريق|حي) [\p{Arabic}]+(?: [\p{Arabic}]+){0,2}(?:،? (?:رقم )?\d{1,5})?"
    r"|(?:मकान (?:नं\.?|संख्या) )?\d{1,5}(?:/\d+)?,? [\p{Devanagari}]+(?: [\p{Devanagari}]+){0,2} (?:मार्ग|नगर|रोड|गली|पथ)"
    r"|(?:บ้านเลขที่ )?\d{1,4}(?:/\d{1,4})? (?:ซอย ?[\p{Thai}]+ ?\d* )?ถนน ?[\p{Thai}]+"
)
HOUSE = re.compile(r"\d[a-zA-Z]?(?: bis| ter)?,? (?:[^\W\d_a-z]|rue|bd|boul|ave|av\.|place|chemin|quai|impasse|allée)")
UNIT_AT, TOWN_AT = regex.compile(UNIT), regex.compile(TOWN)

# Particles inside names.
PARTICLES = frozenset("de del della di da do dos das du des la le les los las van der den vom von zu zur ter ten op y e i af av bin ibn ben al el abu san santa st mac af".split())
# Words that are part of a street, school or place, or stand before a name as a title, or before a number.
PLACE_WORDS = frozenset((_EN + "|Library|School|Academy|College|University|Museum|Port|Lake|Mount|Station|Mill|Mills|Harbor|Harbour|Bridge|Hall|Church|Hospital|Club|River|Villa|Lower|Upper|North|South|East|West|New|Old|Bay|Beach|Island|Valley|Garden|Gardens|Center|Centre|Theater|Theatre|Institute|Company|Inc|Ltd|Bahnhof|Schule|Plan|Escuela|Universidad|Colegio|École|Lycée|Université|Instituto|Stop").upper().split("|"))
NUMBER_WORDS = frozenset("NO NR NUM NÚM FIG ID SSN ISBN TEL FAX APT UNIT FLAT SUITE ROOM PIN TAX".split())
DATES = frozenset("JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER MONDAY TUESDAY WEDNESDAY THURSDAY FRIDAY SATURDAY SUNDAY MONTAG DIENSTAG MITTWOCH DONNERSTAG FREITAG SAMSTAG SONNTAG JANUAR FEBRUAR MÄRZ MAI JUNI JULI OKTOBER DEZEMBER CHRISTMAS EASTER".split())
TITLES = frozenset("mr mrs ms dr prof counselor coach sr sra señor señora don doña herr frau m mme mlle monsieur madame sir miss doctor professor teacher nurse captain uncle aunt г-н г-жа господин госпожа".split())
_NO_NAME = frozenset("jr".split())
# Function words, by class.
_DETERMINERS = frozenset("the a an this that these those my your his her its our their every each another some any no der die das den dem des ein eine einen einem einer eines kein keine keinen mein meine meinen meinem meiner meines dein sein seine seinen seiner ihr ihre ihren unser unsere unseren jener jene jenen jenem jede jeden jedes el la los las un una unos unas mi mis tu tus su sus nuestro nuestra nuestros este esta ese esa aquel aquella le les une des mon ma mes ton ta sa ses notre nos votre leur leurs cet cette ces im am zum zur vom beim ins".split())
_PREPOSITIONS = frozenset("in on at by to from of with for about near under over behind beside outside inside above past across before after between during despite without through toward into onto since until upon beyond around along against in auf an bei mit von aus nach zu vor hinter neben unter über zwischen für ohne gegen während seit en de a con por para sin sobre entre desde hasta hacia bajo tras à dans par pour sans sous avec chez vers depuis pendant avant après в на с к у о из от до за под для без".split())
_OTHERS = frozenset("i you he she it we they me him us them who what which when where why how and or but so yet nor as if than then because while although though is are was were be been being am has have had do does did will would can could should shall may might must not nobody somebody everybody everyone someone nothing there here once again yesterday today tomorrow tonight only also just even still very most both all ich du er sie es wir ihr und oder aber wenn als weil dass war ist sind hat haben hatte niemand dort hier gestern heute morgen yo él ella nosotros ellos y o pero que cuando donde porque como es era fue no sí nadie ayer hoy je tu il elle nous vous ils elles et ou mais que quand où parce comme est était ne pas personne hier aujourd'hui и или но что когда где я ты он она мы вы они это был была не".split())
FUNCTION = _DETERMINERS | _PREPOSITIONS | _OTHERS
_GERMAN = frozenset("der die das den dem des ein eine einen ich und nicht mit auf im aus war mein meine meinen unser unsere jenen über für nach ist".split())
_ELIDED = re.compile(r"['’]s$|^(?:l|j|n|s|c|m|t|qu)['’]")
_ENGLISH = frozenset("the my and of to a in was is for i it that this our at by with who had but not".split())
# Words after which a person is named.
_INTRODUCE = frozenset("called named llamo llama llamado m'appelle m’appelle s'appelle s’appelle appelle appelé nommé heiße heisse heißt namens genannt i'm i’m soy suis bin signed sincerely yours truly regards faithfully respectfully atentamente cordialement saludos grüße hochachtungsvoll contact dear thanks thank gracias merci danke зовут спасибо уважением counselor coach teacher professor director according ask meet met says said belongs".split())
_NAME_IS = frozenset(("name is", "name's", "names is", "nombre es", "nom est", "name ist", "prénom est", "имя"))
# Words before a person in scripts without capitals.
_HAN_BEFORE = ("我叫", "名叫", "叫做", "姓名", "名字是", "老师", "同学", "联系", "感谢", "谢谢", "我是", "私は", "名前は")
_HAN_AFTER = ("老师", "同学", "先生", "女士", "教授", "医生", "说", "和我", "さん", "先生", "様", "くん", "氏", "です", "と申します", "といいます")
_ZH_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_JA_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 池田 橋本 阿部 石川 前田 藤田 小川 岡田 後藤 長谷川 石井 村上 近藤 坂本 遠藤 青木 藤井 西村 福田 太田 三浦 岡本 松田 中島 中野 原田 小野 田村 竹内 金子 和田 中山 石田 上田 森田 柴田 酒井 工藤 横山 宮崎 宮本 内田 高木 安藤 島田 谷口 大野 丸山 今井 高田 藤原 増田".split()
HAN_NAMES = regex.compile(rf"(?:{'|'.join(_JA_FAMILY)})[ 　]?(?:\p{{Han}}{{1,3}}|[\p{{Hiragana}}]{{2,4}})|[{_ZH_FAMILY}]\p{{Han}}{{1,2}}|[\p{{Katakana}}ー]{{2,}}[・＝][\p{{Katakana}}ー]{{2,}}(?:[・＝][\p{{Katakana}}ー]{{2,}}){{0,2}}")
INTRODUCED = regex.compile(
    r"(?:(?:اسمي|اسمه|اسمها|السيد|السيدة|الأستاذ|الأستاذة|الدكتور|الدكتورة|المعلم|المعلمة|يدعى|تدعى|شكرا لـ|إلى السيد) (\p{Arabic}{2,}(?: \p{Arabic}{2,}){1,3})"
    r"|(?:मेरा नाम|उसका नाम|श्री|श्रीमती|कुमारी) ([\p{Devanagari}]{2,}(?: [\p{Devanagari}]{2,}){1,2})"
    r"|(?<![\p{Thai}])(?:ผม|ฉัน|ดิฉัน|หนู)?(?:ชื่อ|นาย|นางสาว|นาง|คุณ) ?(\p{Thai}{2,9} \p{Thai}{2,12})(?!\p{Thai}))"
)

_WORD = r"(?:\p{Lu}\p{M}*(?:[\p{L}\p{M}]|['’-](?=\p{L}))+)"
_LINK = "(?:" + "|".join(sorted(PARTICLES)) + "|d'|l')"
RUN = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{Nd}}@._+-])(?:{_WORD}|\p{{Lu}}\.)(?:(?:,? |(?<=\.))(?:{_LINK} )*(?:{_WORD}|\p{{Lu}}\.))+(?![\p{{L}}\p{{M}}@_+]|-\p{{L}})")
PART = regex.compile(rf"{_WORD}|\p{{Lu}}\.|{_LINK}(?= )")
LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
#: A capital word or initial and another part of a name after it.
NAMES_CUE = re.compile(rf"[{_UPPER}][^\s,]*(?:,? |(?<=\.))(?:{_LINK} )*[{_UPPER}]")
#: Words of Latin letters in lower case, and what may stand between the two words of a name and after it.
LOWER = re.compile(r"(?<![^\W_])(?<![@.+/-])[a-zß-öø-ɏ]{2,}(?:-?[a-zß-öø-ɏ]+)+(?![^\W_]|[@+-])")
LOWER_LINK = re.compile(r"(,?)(?: [a-z]\.)? ")
LOWER_TAIL = re.compile(r", [a-z]\.| [a-z]\.(?= )")
_NO_CAPITALS = re.compile(r"[\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]")
_TOKENS = regex.compile(r"[\p{L}\p{M}'’]+|[^\s\p{L}\p{M}\p{Nd}]|\p{Nd}+")


@functools.cache
def ordinary_words(folder: str = VOCABULARIES) -> frozenset[str]:
    """Whole words in lower case that are one token of a vocabulary in ``folder``; at most the sizes of the vocabularies."""
    out = set()
    for name in WORD_TOKENS:
        path = os.path.join(folder, f"{name}.tiktoken")
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(f"{name}.tiktoken")
        with open(path, "rb") as lines:
            for line in lines:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" " and (w := token[1:].decode("utf-8", "replace")).isalpha() and w.islower() and len(w) > 1:
                    out.add(w)
    return frozenset(out)


def _left_class(words: list[str]) -> str:
    if not words:
        return "^"
    last, two = words[-1], " ".join(words[-2:])
    if two in _NAME_IS or last in _NAME_IS or last in _INTRODUCE:
        return "introduce"
    if last in ":,;" and len(words) > 1 and words[-2] in _INTRODUCE:
        return "introduce" + last
    for name, group in (("title", TITLES), ("det", _DETERMINERS), ("prep", _PREPOSITIONS), ("other", _OTHERS)):
        if last in group:
            return name
    return "mark" if last in ".!?…“”\"»«" else "digit" if last[0].isdigit() else last if not last[0].isalpha() else "word"


def _context(s: str, a: int, b: int, named: bool) -> list[str]:
    left, right = s[max(0, a - 40) : a], s[b : b + 24]
    whole = left.rsplit("\n", 1)
    lw, rw = _TOKENS.findall(whole[-1].lower())[-3:], _TOKENS.findall(right.split("\n", 1)[0].lower())[:2]
    before = _TOKENS.findall(whole[0].lower())[-2:] if len(whole) > 1 and not lw else []
    l1, l2, r1 = (lw[-1] if lw else "^"), (" ".join(lw[-2:]) if lw else "^"), (rw[0] if rw else "$")
    l1, r1 = ("0" if l1.isdigit() else l1), ("0" if r1.isdigit() else r1)
    if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", l1):  # no spaces: the last character speaks
        l1, l2 = l1[-1], l1[-2:]
    kind = "line" if not lw and not rw else "start" if not lw else "end" if not rw else "in"
    left_class = _left_class(lw)
    right_class = "$" if not rw else "function" if rw[0] in FUNCTION else "word" if rw[0][0].isalpha() else "digit" if rw[0].isdigit() else rw[0]
    if not named:
        return ["l1=" + l1, "l2=" + l2, "r1=" + r1, kind]
    return ["l1=" + l1, "l2=" + l2, "r1=" + r1, kind, "lc=" + left_class, "rc=" + right_class, f"lr={left_class},{right_class}", f"above={kind},{_left_class(before)}"]


def _shape(t: str) -> str:
    t = regex.sub(r"\d", "d", t)
    t = regex.sub(r"[A-Z]", "A", t)
    return regex.sub(r"d{5,}", lambda m: f"d{len(m[0])}", t)


def _class_of(word: str, known: frozenset[str]) -> str:
    """What a word is known to be: function word, place word, date, label, title, ordinary word, or none of these (X)."""
    up, low = word.upper(), word.lower()
    if low in FUNCTION or _ELIDED.search(low):
        return "F"
    if low in TITLES:
        return "T"
    if up in PLACE_WORDS or low in _NO_NAME:
        return "P"
    if up in DATES:
        return "D"
    if up in NUMBER_WORDS:
        return "N"
    return "V" if low in known else "X"


def _names(s: str, add, mails: str) -> None:
    known = ordinary_words()
    lower: set[str] | None = None
    for m in RUN.finditer(s) if NAMES_CUE.search(s) else ():
        parts = [(p.start(), p.end(), p[0]) for p in PART.finditer(s, m.start(), m.end())]
        n = len(parts)
        kinds = ["i" if len(p[2]) == 2 and p[2][1] == "." else "p" if p[2][0].islower() else "w" for p in parts]
        classes = [_class_of(p[2], known) if k == "w" else k for p, k in zip(parts, kinds, strict=True)]
        if lower is None:
            lower = {w for w in LETTERS.findall(s) if w.islower()}
        around = s[max(0, m.start() - 30) : m.start()] + s[m.end() : m.end() + 30]
        shouted = sum(map(str.isupper, around)) > sum(map(str.islower, around)) and any(map(str.isalpha, around)) or n > 2 * PARTS
        near = LETTERS.findall(s[max(0, m.start() - 80) : m.end() + 80].lower())
        german = sum(w in _GERMAN for w in near) >= 2
        for i in range(n):
            if kinds[i] == "p" or classes[i] in "FNT":
                continue
            for j in range(i + 1, min(n, i + PARTS)):
                if classes[j] in "FNT":
                    break
                full = [k for k in range(i, j + 1) if kinds[k] == "w"]
                if kinds[j] == "p" or len(full) < 2:
                    continue
                a, b = parts[i][0], parts[j][1]
                commas = s[a:b].count(",")
                if commas > 1 or kinds[j] == "i" and not commas:  # only Family, First I. ends with an initial
                    continue
                words = [parts[k][2] for k in full]
                cs = "".join(classes[k] for k in full)
                form = "".join("i" if kinds[k] == "i" else "p" if kinds[k] == "p" else "U" if parts[k][2].isupper() and len(parts[k][2]) > 1 else "C" for k in range(i, j + 1))
                lows = [w.lower() for w in words]
                features = [f"form={form},{commas}", f"first={cs[0]}", f"last={cs[-1]}", f"classes={''.join(sorted(set(cs)))}", f"plain={cs.count('V')}/{len(cs)}", f"n={len(full)}", f"commas={commas}", f"shout={shouted}", f"german={german}"]
                features.append(f"before={classes[i - 1] if i else '-'}")
                features.append(f"after={classes[j + 1] if j < n - 1 else '-'}")
                features.append(f"own={sum(w in lower for w in lows) > 0}")
                features.append(f"mail={any(len(w) > 2 and w in mails for w in lows)}")
                line = s.rfind("\n", 0, a) + 1
                sentence = a == line or s[max(0, a - 2) : a - 1] in (".", "!", "?", "…", ":")
                features.append(f"part={' '.join(parts[k][2] for k in range(i, j + 1) if kinds[k] == 'p')},{german}")
                features.append(f"begins={sentence},{cs[0]},{german}")
                features.append(f"de={german},{_left_class(_TOKENS.findall(s[max(line, a - 30) : a].lower())[-3:])}")
                if len(set(cs)) == 1 and cs[0] == "X" and not german:
                    features.append("unknown")
                add(a, b, "name", features)
    before, x = 0, ""
    for m in LOWER.finditer(s):
        y = m[0]
        if y in known or y in FUNCTION or y in TITLES:
            x = ""
            continue
        end, first, x, before = before, x, y, m.end()
        if not first:
            continue
        a = end - len(first)
        link = LOWER_LINK.fullmatch(s, end, m.start())
        if not link:
            continue
        tail = LOWER_TAIL.match(s, m.end())
        b = tail.end() if tail and link[1] else m.end()  # only family name, first name and initial ends with an initial
        line = s.rfind("\n\n", 0, a)  # the sentence goes on over a single line break
        left = _left_class(_TOKENS.findall(s[max(line + 1, a - 30) : a].lower())[-3:])
        near = LETTERS.findall(s[max(0, a - 80) : b + 80].lower())
        # A vocabulary mostly of English words says little about words of other languages.
        english = sum(w in known for w in near) * 4 >= 3 * len(near) and sum(w in _ENGLISH for w in near) >= 2
        mail = any(w in mails for w in (first, y))
        start = s[max(0, a - 1) : a] == "\n" and _left_class(_TOKENS.findall(s[max(0, a - 30) : a].lower())[-2:]).startswith("introduce")
        if english and left not in ("det", "word", "digit") or left.startswith("introduce") or mail or start:
            add(a, b, "name", [f"low={english}", f"low,mail={mail}", f"low,left={english},{left}", f"low,comma={bool(link[1])}"])
    if s.isascii() or not _NO_CAPITALS.search(s):
        return
    for m in HAN_NAMES.finditer(s):
        a, b = m.span()
        ja = any(m[0].startswith(f) for f in _JA_FAMILY) or "\u30a0" <= m[0][0] <= "\u30ff"
        before = next((w for w in _HAN_BEFORE if s.endswith(w, 0, a)), "")
        inside = regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", s[a - 1 : a]) is not None
        for e in range(a + 2, b + 1) if not ja else (b,):
            after = next((w for w in _HAN_AFTER if s.startswith(w, e)), "")
            if inside and not before and not after:  # a name in running text without a sign of a person is not told from other words
                continue
            edge = e == len(s) or not regex.match(r"[\p{Han}\p{Hiragana}]", s[e])
            add(a, e, "name", [f"han={ja},{bool(before)},{bool(after)},{edge}", f"hanb={before}", f"hana={after}", f"hann={e - a}"])
    for m in INTRODUCED.finditer(s):
        g = next(k for k in (1, 2, 3) if m[k])
        a, b = m.span(g)
        ends = [a + x.start() for x in re.finditer(" ", m[g])][1:] + [b]
        for e in ends:
            add(a, e, "name", [f"introduced={g}", f"introduced,n={s[a:e].count(' ') + 1}"])


def candidates(s: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of all candidate segments of a shadow text."""
    out: list[tuple[int, int, str, list[str]]] = []

    def add(a: int, b: int, kind: str, features: list[str]) -> None:
        out.append((a, b, kind, [f"{kind}|{f}" for f in ["bias", *features, *_context(s, a, b, kind == "name")]]))

    mails = []
    if EMAIL_CUE.search(s):
        for m in EMAIL.finditer(s):
            t = m[0]
            spelled = "@" not in t
            mails.append(t.lower())
            add(m.start(), m.end(), "email", [f"spelled={spelled}", f"tokens={bool(regex.search(r'[._+0-9-]', regex.split(AT, t)[0]))}", f"dotted={'.' in regex.split(AT, t)[-1]}"])
    for m in NUMBER.finditer(s) if NUMBER_CUE.search(s) else ():
        t = m[0]
        digits = sum(c.isdigit() for c in t)
        if digits < 6 or digits > 17:
            continue
        a, b = m.start(), m.end()
        if t.count("(") != t.count(")"):
            if t[0] == "(" and ")" not in t:
                a += 1
            elif t[-1:] != ")":
                continue
            t = s[a:b]
        features = ["shape=" + _shape(t), f"digits={digits}", f"plus={t[0] == '+'}", f"zero={t[0] == '0'}", f"letters={any(c.isalpha() for c in t)}", f"seps={''.join(sorted({c for c in t if not c.isalnum()}))}", f"groups={len(regex.findall(r'[0-9]+', t))}"]
        for kind in ("phone", "id_number"):
            add(a, b, kind, features)
    streets = list(STREETS_BY_NUMBER.finditer(s)) if HOUSE.search(s) else []
    if any(x in s for x in STREET_CUES):
        streets += STREETS_BY_NAME.finditer(s)
    if not s.isascii() and any(x in s for x in OTHER_STREET_CUES):
        streets += [m for m in OTHER_STREETS.finditer(s) if any(map(str.isdigit, m[0]))]
    for m in streets:
        a, b = m.start(), m.end()
        ends = [(b, 0)]
        unit = UNIT_AT.match(s, b)
        if unit:
            ends.append((unit.end(), 1))
        town = TOWN_AT.match(s, ends[-1][0])
        if town:
            ends.append((town.end(), 2))
        for e, parts in ends:
            while e > a and s[e - 1] in ".,;":
                e -= 1
            add(a, e, "address", [f"parts={parts}", f"rest={len(ends) - 1 - [p for _, p in ends].index(parts)}", f"code={bool(regex.search(r'[0-9]{4,6}$', s[a:e]))}"])
    _names(s, add, " ".join(mails))
    return out


def _lattice(cands: list, weights: dict[str, float]) -> list[tuple[int, int, float]]:
    return [(a, b, sum(weights.get(f, 0.0) for f in fs)) for a, b, _, fs in cands]


def decode(cands: list, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of segments that do not overlap: a semi-Markov Viterbi pass over the candidates' ends."""
    if not cands:
        return []
    scored = sorted(((b, a, sc, k) for (a, b, sc), (_, _, k, _) in zip(_lattice(cands, weights), cands, strict=True)), key=lambda x: (x[0], x[1]))
    ends = [0]
    best: list[tuple[float, tuple | None, int]] = [(0.0, None, 0)]  # at each end: score, segment, place before it
    for b, a, sc, k in scored:
        p = bisect.bisect_right(ends, a) - 1
        v = best[p][0] + sc
        if b == ends[-1]:
            if v > best[-1][0]:
                best[-1] = (v, (a, b, k), p)
        else:
            ends.append(b)
            best.append((v, (a, b, k), p) if v > best[-1][0] else (best[-1][0], None, len(best) - 1))
    out, i = [], len(best) - 1
    while i > 0:
        _, seg, p = best[i]
        if seg:
            out.append(seg)
        i = p
    return out[::-1]


def _marginals(segs: list[tuple[int, int, float]]) -> list[float]:
    """Probability of each scored segment (start, end, score): forward and backward sums over the lattice."""
    points = sorted({0, *(x for a, b, _ in segs for x in (a, b))})
    at = {p: i for i, p in enumerate(points)}
    n = len(points)
    fwd, bwd = [-math.inf] * n, [-math.inf] * n
    fwd[0] = bwd[-1] = 0.0
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for a, b, w in segs:
        by_end.setdefault(at[b], []).append((at[a], w))
        by_start.setdefault(at[a], []).append((at[b], w))

    def total(x: list[float]) -> float:
        m = max(x)
        return m if m == -math.inf else m + math.log(sum(math.exp(v - m) for v in x))

    for i in range(1, n):
        fwd[i] = total([fwd[i - 1], *(fwd[a] + w for a, w in by_end.get(i, ()))])
    for i in range(n - 2, -1, -1):
        bwd[i] = total([bwd[i + 1], *(bwd[b] + w for b, w in by_start.get(i, ()))])
    z = fwd[-1]
    return [math.exp(min(0.0, fwd[at[a]] + w + bwd[at[b]] - z)) for a, b, w in segs]


# Words from which training lines are made: fixed values, by kind.
_SYLLABLES = "ka lo mi ren tal vor bes dun fel gar hol jen kir lam mor nis pol quin ras sel tor ulm ver win yor zan bri cal del ein fra gwe hes ila jor kel".split()
_ENDINGS = ["son", "berg", "ova", "ini", "ez", "field", "ström", "mann", "wick", "son", "etti", "nko", "ard", "", "", ""]
_FIRST = "James Mary Robert Linda Michael Sarah David Karen Thomas Nancy Daniel Emily George Laura Peter Julia Simon Alice Victor Clara Hassan Amina Omar Leila Yusuf Fatima Ravi Priya Arjun Anita Wei Mei Kenji Yuki Hiro Aiko Carlos Lucía José Elena Miguel Sofía Pierre Amélie Luc Chloé Hans Greta Jürgen Anke Ivan Olga Pavel Natasha Marco Giulia Sven Astrid Kofi Ama".split()
_LAST = "Smith Jones Taylor Brown Wilson Evans Walker Wright Turner Parker Cooper Morgan Bell Murphy Bailey Kelly Howard Ward Brooks Gray Watson Price Bennett Wood Barnes Ross García Martínez López Sánchez Pérez Gómez Dubois Moreau Laurent Lefebvre Girard Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Ivanov Petrov Sokolov Kuznetsov Rossi Bianchi Lindqvist Okafor Mensah Khan Singh Sharma Patel Tanaka Suzuki".split()
_RU_FIRST, _RU_LAST = "Иван Ольга Павел Наталья Сергей Анна Дмитрий Мария Алексей Елена".split(), "Иванов Петрова Соколов Кузнецова Орлов Лебедева Морозов Волкова Зайцев Павлова".split()
_AR, _HI, _TH = "محمد أحمد فاطمة علي حسن مريم يوسف خالد ليلى سامي العلي حداد منصور".split(), "राम सीता मोहन गीता अनिल सुनीता कुमार शर्मा वर्मा सिंह गुप्ता यादव".split(), "สมชาย สมหญิง วิชัย มาลี ใจดี รักไทย ศรีสุข ทองดี".split()
_NOUNS = "carpet lantern notebook wagon parcel orchard chimney blanket kettle ladder basket saddle fence barn valley cellar candle mirror pillow ribbon hammer violin engine drawer shelf".split()
_ADJECTIVES = "narrow gloomy rusty gentle hollow brittle crimson dusty lopsided weary tangled polished crooked mossy faded homemade".split()
_VERBS = "lifted carried dropped repaired painted followed noticed borrowed ignored admired counted wrapped".split()
# Ordinary words that are no single token of the vocabularies.
_RARE = "gherkin trombone windmill saucepan bonfire scarecrow hedgehog doorknob teaspoon driftwood snowdrift grumbled mumbled scribbled shrugged giggled stumbled creaky wobbly drowsy soggy crumpled threadbare moonlit sunlit lopsided unlit tinkled rusted".split()
_ROLES = "Painter Singer Author Manager Senator Pilot Poet Gardener Reporter Editor Composer Neighbor Cousin".split()
_DE_NOUNS = "Teppich Garten Schrank Koffer Brief Vogel Baum Spiegel Kuchen Mantel Apfel Stuhl Ofen Hammer Lehrerin Verkäufer Fahrerin Schwester Nachbar Bruder Wald Brunnen Turm Keller".split()
_DE_VERBS = "kaufte suchte fand brachte zeigte holte sah malte trug versprach".split()
_DE_ADJECTIVES = "alten großen kleinen roten leeren stillen zweiten neuen".split()

# {E} email, {P} phone, {I} identity number, {A} address, {Q} address in another script, {N} name, {R} {Z} {J} {K} {H} {T} names in other scripts;
# {L} place, {W} an ordinary phrase, {V} a verb, {C} a role, {O} a pronoun, {X} a word of no language.
_FRAMES = """Dear {N}, thank you for the parcel.|This is {N} speaking.|I'm {N}, the new tenant.|The name's {N}.|Her full name is {N}.|I was called {N} after a saint.|We met {N} at the fair.|Last week {N} came by.|Then {N} and I went home.|Later {N} and her son joined us.|"Stop," {N} shouted.|{N} whistled.|{N} smiled and left.
{N} wrote back at once.|{N} was not amused.|{N} has a dog.|As {N} told us, it can't be done.|The report by {N} is here.|A call from {N} woke me.|I sent it to {N}, who keeps the keys.|It was given to {N} in spring.|Best wishes, {N}|Yours truly,\\n{N}|Kind regards,\\n{N}\\n{A}\\n{P}|Regards,\\n{N}\\n{P}|Respectfully,\\n{N}\\n{A}|See you soon,\\n{N}|Written by {N}
Mr. {N} runs the shop.|Ms. {N} came late.|Coach {N} noted it.|Dr. {N} signed the sheet with number {I}.|Teacher {N} kept a list.|Nurse {N} took my blood.|Officer {N} copied my licence, {I}, into a book.|Please meet {N} and {N}.|Between {N} and me there was a bench.|Witness: {N}|Tenant: {N}, {A}|Owner: {N}, {P}.|Sender: {N} <{E}>
{N} ({P}) can help.|{N} ({E}) will reply.|{N} - {E}|{N}, {A}|Mail for {N}: {E}.|You may write {N} at {E}.|Write to {E} today.|My inbox: {E}|E-mail: {E}|<{E}>|Reply to {E}, please.|Questions? {E}|The list is run from {E} by hand.|I use {E} or {E} these days.|{E}|Both {E} and {P} work.|{P}, {E}
Dial {P} now.|Phone {P} or write.|Ring {P} at night.|My mobile is {P}.|Fax: {P}|Cell {P}|Is it {P}, or {P}?|Her number, {P}, was busy.|Try {P} and wait for {N}.|Leave word at {P} for {N}.|{P}|Mobile: {P} / {E}|Office: {P}.|SMS {P} for help.
Social security: {I}|Licence {I} was mine.|My card has {I} on it.|Insurance no. {I}, issued to {N}|Passport: {I}|His passport, {I}, had expired.|The holder of {I} is {N}.|{I} is what the clerk read.|She copied {I} by hand.|National ID {I}|Tax number: {I}.|They misread {I} again.|{I}
We moved to {A} in May.|Our flat is at {A}, near the park.|Deliver it to {A} please.|Ship to: {A}|The shop at {A} is shut.|From {A} it is a short walk.|{A}|Come by {A} some day.|The label read {A}.|His house, {A}, was sold.|Bills go to {A} each month.|{N} of {A} won.
Soy {N}, del tercer curso.|Se llama {N}.|Ella se llama {N} y canta.|Mi nombre es {N}.|Hablé con {N} ayer.|Un saludo de {N}.|Firmado: {N}|La señora {N} vino.|Se lo debo a {N}, mi vecina.|El teléfono de {N} es {P}.|Llámeme al {P}.|Mi correo: {E}|Escriba a {E} o marque {P}.|Mi DNI: {I}|Con pasaporte {I}.|Mi dirección: {A}.|Nos mudamos a {A}.|Domicilio: {A}|Tel.: {P}
Moi, c'est {N}.|Il s'appelle {N}.|On m'appelle {N} ici.|Mille mercis à {N}, du port.|Je suis {N}, votre voisin.|Mon nom est {N}.|J'ai vu {N} hier.|Signé : {N}|Madame {N} est venue.|Un mot de {N}, du quartier.|Appelez le {P}.|Tél. : {P}|Mon adresse : {E}|Écrire à {E} ou au {P}.|Ma carte : {I}|Passeport {I}.|Adresse : {A}.|On loge {A}.|Nous vivons au {A}.|Grâce à {N}, j'ai fini.
Ich bin {N}.|Sie heißt {N}.|Er heißt {N} und lacht.|Ein Mann namens {N} kam.|Die Frau, genannt {N}, ging.|Mein Name ist {N}.|Ich heisse {N} und koche gern.|Man nennt mich {N}.|Gestern traf ich {N}.|Frau {N} kam.|Herr {N} ging.|Grüße von {N}|Unterschrift: {N}|Ein Brief von {N} ({E}).|Mit {N} ging ich heim.|Mein Dank gilt {N}.|Rufen Sie {P} an.|Tel.: {P}|Mobil {P}|E-Mail: {E}|Schreiben Sie an {E} oder {P}.|Ausweis: {I}|Steuernummer {I}.|Wohnhaft: {A}.|Wir wohnen {A}.|Die Adresse ist {A}.
Меня зовут {R}.|Я {R}.|С уважением, {R}|Вчера {R} пришёл.|Учитель {R} знает.|Пишите: {E}|Тел.: {P}|Мой номер {P}.|Почта: {E}|Живу: {Q}.|Паспорт {I}.|我叫{Z}。|老师{Z}说过。|邮箱：{E}|电话：{P}|请拨{P}。|写信到{E}吧。|住在{Q}。|私は{J}です。|{J}さんが来た。|メール：{E}|電話：{P}。|住所は{Q}。|番号は{P}です。
اسمي {K}.|السيد {K} هنا.|البريد {E}|هاتف {P}|أسكن في {Q}.|मेरा नाम {H} है।|श्री {H} आए।|ईमेल {E}|फ़ोन {P}|पता: {Q}|ชื่อ {T} ครับ|คุณ {T} มา|อีเมล {E}|โทร {P}|ที่อยู่ {Q}|My {W} was at {L}.|I liked {W} and {N} did not.|{N} {V} {W}.|{X} {N} {X}.|{X} {X} {N}.|{X} {X} {N}, {X} {X}.|{X} {N}|{X} {V} {N} {X}.|{C} {N} {V} it.|The {X} {N} {V} {W}.|{O} {V} {N} {X}.|{O} {V} that {N} {V} {W}.|{C} {N}, {X} {X}.|{X} {X}: {N}|{O} {N} {X} {X}.|{N} {X} {X}.|My friend {N} {V} it.|{W} belongs with {N}, I think.""".replace("\n", "|").split("|")


def labelled_lines(n: int = TRAINING_LINES, seed: int = 11, frames: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to three lines with their true segments, made from frames, lines without a segment and invented values;
    same arguments, same lines. ``frames`` replaces the frames, for held-out ones."""
    r = random.Random(seed)
    pick = r.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    made = lambda k=2: "".join(pick(_SYLLABLES) for _ in range(k)).capitalize()
    first = lambda: pick(_FIRST) if r.random() < 0.35 else made(2)
    last = lambda: pick(_LAST) if r.random() < 0.35 else made(r.randint(1, 2)) + pick(_ENDINGS)
    mails: list[str] = []

    def name() -> str:
        f, x = first(), last()
        form = r.random()
        f = f + "-" + first() if r.random() < 0.1 else f
        i = pick("ABCDEFGHJKLMNPRST")
        if form < 0.5:
            t = f"{f} {x}"
        elif form < 0.62:
            t = f"{f} {i}. {x}"
        elif form < 0.76:
            t = f"{x}, {f}"
        elif form < 0.84:
            t = f"{x}, {f} {i}."
        elif form < 0.88:
            t = f"{i}. {pick('ABDKL')}. {x}" if r.random() < 0.2 else f"{f} {first()} {x}"
        elif form < 0.94:
            t = f"{f} {pick(['van der', 'de la', 'von', 'de', 'van', 'del', 'bin', 'di', 'al', 'dos'])} {x}"
        elif form < 0.97:
            t = f"{f} {first()} {pick(['van der', 'de la', 'von', 'de'])} {x}"
        else:
            t = f"{f} {first()} {last()} {x}"
        mails.append(f"{f.split('-')[0]}.{x}".lower())
        k = r.random()
        return t.upper() if k < 0.07 else t.lower() if k < 0.15 else t

    def email() -> str:
        f, x = (mails[-1].split(".", 1) if mails and r.random() < 0.5 else (first().lower(), last().lower()))
        f, x = (re.sub("[^a-z]", "", w.replace("ö", "o").replace("é", "e")) or "an" for w in (f, x))
        u = pick([f"{f}.{x}", f"{f[0]}{x}", f"{x}-{f}", f"{f}_{d(2)}", f"{f}{d(3)}", f"{f}.{x}+{made(1).lower()}", x])
        at = pick(["@"] * 8 + [" @ ", " [at] ", " (at) ", " at "])
        dot = "." if at.strip() == "@" else pick([" dot ", " (dot) ", "."])
        t = u + at + made(2).lower() + dot + pick(["example", "test", "invalid", "org", "net", "com"])
        return t.upper() if r.random() < 0.06 else t

    def phone() -> str:
        return pick([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"1-800-{d(3)}-{d(4)}", d(10), f"{d(3)}-{d(4)}", f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}",
            f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"9{d(2)} {d(3)} {d(3)}", f"6{d(2)}-{d(2)}-{d(2)}-{d(2)}",
            f"+49 (0){d(2)} {d(5)}-{d(3)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(3)}/{d(7)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"8 ({d(3)}) {d(3)} {d(2)} {d(2)}", f"+86 {d(3)} {d(4)} {d(4)}", f"{d(3)}-{d(4)}-{d(4)}", f"0{d(1)}-{d(4)}-{d(4)}", f"0{d(2)}({d(3)}){d(4)}"])

    def number() -> str:
        return pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"X{d(8)}", f"L{d(1)}X{d(6)}", f"QQ {d(2)} {d(2)} {d(2)} C", f"{pick('ABCX')}{pick('ABQ')} {d(2)} {d(2)} {d(2)} {pick('ABCD')}", f"{d(8)}-{pick('TRWAG')}", f"{d(8)}{pick('TRWAG')}", f"X-{d(7)}-{pick('TRWAG')}",
            f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", d(15), d(13), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)}{d(3)}{d(3)}{d(3)}", f"{pick('CFGHJK')}{d(8)}", f"P{d(7)}"])

    def place() -> str:
        return pick([f"Port {made(2)}", f"Lake {made(2)}", f"{made(2)} Hill", f"{made(2)} Mills", f"Lower {made(2)}", f"{made(2)} Bridge", f"{made(2)} Library", f"{made(2)} {made(1)} Academy", f"St. {made(2)} Church", f"{made(2)} Street", f"{made(2)} Lane", f"{made(2)} High School"])

    def address() -> str:
        town = pick([made(2), f"{made(1)} {made(2)}", "Lower " + made(2), "Port " + made(2), made(2) + " Hill"])
        k = r.random()
        if k < 0.55:
            t = f"{r.randint(1, 999)} {made(2)} {pick('Street St St. Road Rd Avenue Ave Lane Drive Close Court Way'.split())}"
            if r.random() < 0.4:
                t += pick([f", Apt {d(2)}B", f", Unit {d(2)}", f", Flat {d(1)}", f", #{d(2)}B", f", Suite {d(2)}"])
            if r.random() < 0.5:
                t += f", {town}" + pick(["", f" {d(5)}", f", {pick(['ZZ', 'QX', 'NY', 'TX'])} {d(5)}"])
            return t.removesuffix(".")
        if k < 0.7:
            t = f"{pick(['calle del', 'calle de la', 'plaza del', 'avda. de la', 'C/', 'Calle'])} {made(2)}{pick([' ', ', ', ' n.º '])}{r.randint(1, 999)}" + pick(["", ", 2.º B", ", 1.º A"])
            return t + pick(["", f", {d(5)} Villa {made(2)}", f", {d(5)} {made(2)}"])
        if k < 0.85:
            return f"{r.randint(1, 999)}{pick([' ', ', '])}{pick(['rue', 'bd', 'avenue', 'place'])} {pick(['des', 'du', 'de la'])} {made(2)}{pick(['', '-' + made(2)])}" + pick(["", f", {d(5)} {made(2)}-sur-{made(2)}"])
        return f"{pick([made(2) + 'gasse', made(2) + 'weg', made(2) + 'straße', 'Am Alten ' + made(2), 'Im ' + made(2)])} {r.randint(1, 999)}{pick(['', 'a', 'b'])}" + pick(["", f", {d(5)} {made(2)}stadt"])

    def address_elsewhere() -> str:
        n = r.randint(1, 199)
        return pick([f"ул. {pick(_RU_LAST)}, д. {n}", f"ул. {pick(_RU_LAST)}, д. {n}, кв. {n}", f"проспект Мира, {n}", f"北京市海淀区青年路{n}号", f"长江大道{n}号", "東京都千代田区丸の内1-2-3", f"大阪府北区梅田{n % 9 + 1}丁目{n}番",
            f"{n} شارع الملك فهد", f"شارع النيل {n}", f"{n}, महात्मा गांधी मार्ग", f"मकान नं. {n}, शास्त्री नगर", f"{n}/1 ถนนสุขุมวิท"])

    def noun() -> str:
        return f"{pick(['the', 'my', 'a', 'our', 'every', 'that'])} {pick(_ADJECTIVES)} {pick(_NOUNS)}"

    def german_noun() -> str:
        return f"{pick(['den', 'einen', 'meinen', 'jenen', 'unseren'])} {pick(_DE_ADJECTIVES)} {pick(_DE_NOUNS)}"

    def plain() -> str:
        k = r.random()
        if k < 0.12:
            t = f"{pick(['Beside', 'Near', 'Above', 'Past', 'Under', 'Across', 'Then', 'Nobody', 'Once', 'In'])} {place()}, {noun()} {pick(_VERBS)} {noun()}."
        elif k < 0.2:
            t = f"We {pick(_VERBS)} {noun()} at {place()} and {place()}{pick(['.', ' track.', ' stop.', ' as ever.'])}"
        elif k < 0.23:
            t = f"{pick(_DE_NOUNS)} {pick(_DE_NOUNS)} {pick(['in der', 'auf dem', 'und', 'mit dem'])} {pick(_DE_NOUNS)} {pick(['der', 'des', 'von', 'zu'])} {pick(_DE_NOUNS)} {pick(_DE_VERBS)} {german_noun()} {pick(['der', 'und'])} {pick(_DE_NOUNS)}."
        elif k < 0.32:
            t = f"{pick(['Der', 'Die', 'Meine', 'Unser', 'Mein', 'Eine'])} {pick(_DE_NOUNS)} {pick(_DE_VERBS)} {german_noun()} {pick(['mit dem', 'aus der', 'im', 'am', 'hinter der', 'auf dem'])} {pick(_DE_NOUNS)}."
        elif k < 0.42:
            words = [pick([pick(_DE_NOUNS), pick(_DE_NOUNS), pick(_DE_VERBS), pick(_DE_ADJECTIVES), pick(["der", "ich", "und", "mit", "dem", "die", "des", "auf", "im", "Wie", "Was", "Die", "Am"])]) for _ in range(9)]
            t = " ".join(words).capitalize()[:1] + " ".join(words)[1:] + pick([".", "?", "!"])
        elif k < 0.48:
            t = f"{noun()} {pick(_VERBS)} {pick(_ADJECTIVES)} {pick(_NOUNS)} {pick(_ADJECTIVES)} {pick(_NOUNS)}, near {place()}; {noun()} {pick(_VERBS)} it.".upper()
        elif k < 0.54:
            t = " ".join(pick([pick(_NOUNS), pick(_ADJECTIVES), pick(["The", "Of", "In", "My"])]).title() for _ in range(r.randint(2, 6)))
        elif k < 0.62:
            t = f"{pick(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Sr.', 'Herr', 'Frau'])} {last()} {pick(_VERBS)} {noun()}."
        elif k < 0.72:
            t = f"{noun()} {pick(_VERBS)} {pick(_ADJECTIVES)} {pick(_NOUNS)} and {pick(_NOUNS)} {pick(_NOUNS)}.".capitalize()
        elif k < 0.755:
            t = f"{pick(['Nobody', 'The', 'I', 'My', 'In', 'She'])} {' '.join(pick(_RARE + _ADJECTIVES + _VERBS + ['the', 'of', 'by', 'inside', 'was', 'who']) for _ in range(7))} {pick(_NOUNS)}."
        elif k < 0.78:
            t = f"{pick(['El', 'La', 'Le', 'Un'])} {made(2).lower()} {made(2).lower()} {pick(['de', 'en', 'sin', 'du'])} {made(2).lower()} {made(1).lower()}."
        else:
            t = pick([
                lambda: f"Order no. {d(2)}-{d(3)}-{d(4)} was late.", lambda: f"Catalog 978-0-{d(2)}-{d(5)}-{d(1)}, p. {d(4)}.", lambda: f"Release 3.{d(1)}.{d(2)} had {d(7)} lines.", lambda: f"At {d(2)}:{d(3)} or {d(4)} per {d(5)}.", lambda: f"It went from {d(2)}.{d(3)} to {d(4)} points.",
                lambda: f"On 20{d(2)}-0{d(1)}-1{d(1)} the {place()} shut.", lambda: f"Lunch @ two, hall {d(2)}.", lambda: f"Follow @{made(2).lower()}{d(1)} there.", lambda: f"{pick('ABCK')}. {pick('DPQR')}. {last()} is cited.", lambda: f"After {d(2)} days order {d(8)} came.",
                lambda: f"Bill {d(3)}-{d(4)}-{d(3)} is due 1{d(1)}.0{d(1)}.20{d(2)}.", lambda: f"That is $1,{d(3)}.{d(2)} or {d(6)} votes.", lambda: f"A dot matrix at school printed {made(2)}.", lambda: f"Parcel {pick('AB')}{d(9)}, item no. {d(7)}.", lambda: f"ISBN {d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}, p. {d(3)}.",
                lambda: f"Soon {made(2)} had gone.", lambda: f"I kept copy{d(1)}.docx and sheet{d(2)}.", lambda: f"In U.S. schools {noun()} {pick(_VERBS)}.", lambda: f"{d(2)}/{d(2)}/{d(4)} and {d(4)}-{d(2)}-{d(2)} are dates.", lambda: f"我{pick('王高白金')}天在学校看了{d(2)}本书。", lambda: f"高い山と白い石が{d(2)}あった。", lambda: "她是高三的学生，于是白天都在家。", lambda: "老师高兴地来了，同学马上到了。", lambda: "老师秋天开始教我们，同学白天看书。",
            ])()
        return t

    lists = {"E": email, "P": phone, "I": number, "A": address, "N": name, "Q": address_elsewhere}
    lists |= {"R": lambda: pick([f"{pick(_RU_FIRST)} {pick(_RU_LAST)}", f"{pick(_RU_LAST)} {pick(_RU_FIRST)} {pick(['Петрович', 'Ивановна'])}"]), "K": lambda: " ".join(r.sample(_AR, r.randint(2, 3))), "H": lambda: " ".join(r.sample(_HI, 2)), "T": lambda: " ".join(r.sample(_TH, 2))}
    lists |= {"Z": lambda: pick(_ZH_FAMILY) + pick(["小明", "伟", "丽华", "国强", "芳"]), "J": lambda: pick(_JA_FAMILY) + pick(["太郎", "花子", " 健", " 由美", "さくら"])}
    words = {"L": place, "W": noun, "V": lambda: pick(_VERBS), "X": lambda: made(r.randint(1, 2)).lower(), "C": lambda: pick(_ROLES), "O": lambda: pick(["Somebody", "Nobody", "She", "They", "I", "He", "It", "Then", "And"])}
    kinds = {"E": "email", "P": "phone", "I": "id_number", "A": "address", "Q": "address"}

    def line(frame: str, text: str, spans: list) -> str:
        for piece in regex.split(r"(\{[A-Z]\})", frame.replace("\\n", "\n")):
            if regex.fullmatch(r"\{[A-Z]\}", piece):
                v = (lists.get(piece[1]) or words[piece[1]])()
                if piece[1] in lists:
                    spans.append((len(text), len(text) + len(v), kinds.get(piece[1], "name")))
                text += v
            else:
                text += piece
        return text

    lines = []
    for _ in range(n):
        text, spans = "", []
        for k in range(r.choice((1, 2, 2, 3))):
            text += pick([" ", " ", "\n\n"]) if k else ""
            text = line(pick(frames or _FRAMES), text, spans) if r.random() < 0.55 else text + plain()
        lines.append((text, spans))
    return lines


_WORD_FEATURE = re.compile(r"\|(?:l1|l2|r1)=")


@functools.cache
def trained(lines: int = TRAINING_LINES, epochs: int = EPOCHS, seed: int = 11) -> dict[str, float]:
    """Weights by feature: AdaGrad on the conditional likelihood of the lattices, with a small quadratic penalty."""
    number: dict[str, int] = {}
    data = []
    for text, spans in labelled_lines(lines, seed):
        cands = candidates(text)
        gold = set(spans)
        if cands:
            # Features by number, and without the neighbouring words themselves, so that their classes carry weight, too.
            full = [[number.setdefault(f, len(number)) for f in fs] for _, _, _, fs in cands]
            classes = [[number[f] for f in fs if not _WORD_FEATURE.search(f)] for _, _, _, fs in cands]
            data.append(([(a, b) for a, b, _, _ in cands], full, classes, [1.0 if (a, b, k) in gold else 0.0 for a, b, k, _ in cands]))
    w, g2 = [0.0] * len(number), [0.0] * len(number)
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(data)
        for places, full, classes, gold in data:
            used = classes if r.random() < 0.5 else full
            segs = [(a, b, sum([w[f] for f in fs])) for (a, b), fs in zip(places, used, strict=True)]
            for fs, y, p in zip(used, gold, _marginals(segs), strict=True):
                g = y - p
                if abs(g) < 1e-3:
                    continue
                for f in fs:
                    h = g - 1e-4 * w[f]
                    g2[f] += h * h
                    w[f] += 0.5 * h / math.sqrt(g2[f] + 0.1)
    return {f: w[i] for f, i in number.items() if w[i]}


#: Words of Cyrillic letters alone, one of them unlike any Latin letter.
_CYRILLIC = regex.compile(r"(?<![\p{L}])(?=[\p{Cyrillic}]*[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ])[\p{Cyrillic}]+(?![\p{L}])")


def _read(text: str) -> tuple[str, list[int] | None]:
    """The shadow, in which words that are Cyrillic throughout stay as they are."""
    s, at = shadow(text)
    if s is text or not (words := list(_CYRILLIC.finditer(text))):
        return s, at
    if at is None:
        at_of = range(len(text) + 1)
    else:
        at_of = dict(zip(at, range(len(at)), strict=True))
    out = list(s)
    for m in words:
        i, j = at_of[m.start()] if at is None else at_of.get(m.start()), at_of[m.end() - 1] if at is None else at_of.get(m.end() - 1)
        if i is not None and j is not None and j - i == m.end() - 1 - m.start():
            out[i : j + 1] = m[0]
    return "".join(out), at


def entities(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the segments of one text, in code points of the text as stored."""
    s, at = _read(text)
    found = decode(candidates(s), weights)
    if at is None:
        return found
    return [(at[a], at[b - 1] + 1, k) for a, b, k in found]


def _mapped(df: DataFrame, key: str, column: str, schema: str, emit) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trained())  # weights only, of a size set by the training lines

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for part in parts:
            yield emit(part, lambda t: entities(t, weights))

    return df.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(run, schema)


def personal_spans(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, kind, char_start, char_end): one row for each occurrence. Null and empty texts have none; no shuffle of texts."""

    def emit(part: pd.DataFrame, find) -> pd.DataFrame:
        rows = [(k, kind, a, b) for k, t in zip(part["key"], part["text"], strict=True) if t for a, b, kind in find(t)]
        return pd.DataFrame(rows, columns=[key, "kind", "char_start", "char_end"])

    return _mapped(df, key, column, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, char_start int, char_end int", emit)


def redacted(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text, found): the text with each occurrence replaced by its kind's placeholder, the rest as it was; found counts them."""

    def emit(part: pd.DataFrame, find) -> pd.DataFrame:
        rows = []
        for k, t in zip(part["key"], part["text"], strict=True):
            spans = find(t) if t else []
            for a, b, kind in reversed(spans):
                t = t[:a] + PLACEHOLDERS[kind] + t[b:]
            rows.append((k, t, len(spans)))
        return pd.DataFrame(rows, columns=[key, "text", "found"])

    return _mapped(df, key, column, f"`{key}` {df.schema[key].dataType.simpleString()}, text string, found int", emit)
