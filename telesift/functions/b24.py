"""Text of the eight-bit broadcast character code (STD-B24)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KANJI, ALNUM, HIRAGANA, KATAKANA = range(4)
#: Signs and blanks of the left half, which the one-byte alphabet has as they are.
PLAIN = re.compile(rb"[\x20-\x7e]+")
# Final bytes that name a one-byte set, and the last eight places of the kana sets.
FINALS = {0x42: ALNUM, 0x4A: ALNUM, 0x30: HIRAGANA, 0x31: KATAKANA}
HIRAGANA_END = "ゝゞー。「」、・"
KATAKANA_END = "ヽヾー。「」、・"
# Fixed values of the standard, as the table of additional signs of the libaribcaption project has them: the additional kanji
# from row 85, place 1 on.  Compatibility forms stand as escapes, for text tools would replace them.
EXTRA_KANJI = "㐂𠅘份仿侚俉傜儞冼㔟匇卡卬詹𠮷呍咖咜咩唎啊噲囤圳圴\ufa10墀姤娣婕寬\ufa11㟢庬弴彅德怗\ufa6b愰昤曈曙曺曻桒鿄椑椻橅檑櫛𣏌𣏾𣗄毱泠洮\ufa45涿淊淸\ufa46潞濹灤\ufa6c𤋮煇燁爀玟玨珉珖琛琡\ufa4a琦琪琬琹瑋㻚畵疁睲䂓磈磠祇禮鿆䄃鿅秚稞筿簱䉤綋羡脘脺\ufa6d芮葛蓜蓬蕙藎蝕蟬蠋裵角諶跎辻迶郝鄧鄭醲鈳銈錡鍈閒雞餃饀髙鯖鷗麴麵"
# Fixed values from the same table: the signs of rows 90 to 94 by their first byte, from place 1 on; a blank is an empty place.
SIGNS = {
    0x7A: "⛌⛍❗⛏⛐⛑ ⛒⛕⛓⛔    🅿🆊  ⛖⛗⛘⛙⛚⛛⛜⛝⛞⛟⛠⛡⭕㉈㉉㉊㉋㉌㉍㉎㉏    ⒑⒒⒓🅊🅌🄿🅆🅋🈐🈑🈒🈓🅂🈔🈕🈖🅍🄱🄽⬛⬤🈗🈘🈙🈚🈛⚿🈜🈝🈞🈟🈠🈡🈢🈣🈤🈥🅎㊙🈀",
    0x7B: "⛣⭖⭗⭘⭙☓㊋〒⛨㉆㉅⛩࿖⛪⛫⛬♨⛭⛮⛯⚓✈⛰⛱⛲⛳⛴⛵🅗ⒹⓈ⛶🅟🆋🆍🆌🅹⛷⛸⛹⛺🅻☎⛻⛼⛽⛾🅼⛿",
    0x7C: "➡⬅⬆⬇⬯⬮年月日円㎡㎥㎝㎠㎤🄀⒈⒉⒊⒋⒌⒍⒎⒏⒐氏副元故前新🄁🄂🄃🄄🄅🄆🄇🄈🄉🄊㈳㈶㈲㈱㈹㉄▶◀〖〗⟐²³🄭\ue2a5\ue2a6\ue2a7\ue2a8\ue2a9\ue2aa\ue2ab\ue2ac\ue2ad\ue2ae\ue2af\ue2b0\ue2b1\ue2b2\ue2b3\ue2b4\ue2b5\ue2b6\ue2b7\ue2b8\ue2b9\ue2ba\ue2bb\ue2bc\ue2bd\ue2be\ue2bf\ue2c0\ue2c1\ue2c2🄬🄫㉇🆐🈦℻",
    0x7D: "㈪㈫㈬㈭㈮㈯㈰㈷㍾㍽㍼㍻№℡〶⚾🉀🉁🉂🉃🉄🉅🉆🉇🉈🄪🈧🈨🈩🈔🈪🈫🈬🈭🈮🈯🈰🈱ℓ㎏㎐㏊㎞㎢㍱  ½↉⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅑⅒☀☁☂⛄☖☗⛉⛊♦♥♣♠⛋⨀‼⁉⛅☔⛆☃⛇⚡⛈ ⚞⚟♬☎",
    0x7E: "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ⑰⑱⑲⑳⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽⑾⑿㉑㉒㉓㉔🄐🄑🄒🄓🄔🄕🄖🄗🄘🄙🄚🄛🄜🄝🄞🄟🄠🄡🄢🄣🄤🄥🄦🄧🄨🄩㉕㉖㉗㉘㉙㉚①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯❶❷❸❹❺❻❼❽❾❿⓫⓬㉛",
}


def extra_table(more: dict[int, str] | None = None) -> dict[int, str]:
    """Sign by two-byte code (7 bits each) in rows 85 to 94; `more` adds those of other rows."""
    out = {(0x75 + i // 94) << 8 | 0x21 + i % 94: c for i, c in enumerate(EXTRA_KANJI)}
    for row, signs in SIGNS.items():
        out |= {row << 8 | 0x21 + i: c for i, c in enumerate(signs) if c != " "}
    return out | (more or {})


def two_byte(row: int, cell: int) -> str:
    """A sign of JIS X 0208 rows 1 to 84 by its 7-bit bytes; code page 932 has the same signs, arranged otherwise."""
    lead = (row - 0x21) // 2 + (0x81 if row < 0x5F else 0xC1)
    if row & 1:
        trail = cell + 0x1F + (cell >= 0x60)
    else:
        trail = cell + 0x7E
    return bytes((lead, trail)).decode("cp932", "replace")


class Decoder:
    """The code's state: what G0 to G3 hold and which two of them the left and right byte ranges use."""

    def __init__(self, table: dict[int, str]):
        self.table = table
        self.g = [KANJI, ALNUM, HIRAGANA, KATAKANA]
        self.left, self.right = 0, 2

    def escape(self, data: bytes, i: int) -> int:
        """Acts on the escape sequence after i; returns where text goes on."""
        nxt = data[i] if i < len(data) else -1
        if nxt in (0x6E, 0x6F):
            self.left = nxt - 0x6C
        elif nxt in (0x7C, 0x7D, 0x7E):
            self.right = 0x7F - nxt
        elif nxt == 0x24:
            i += 1
            kind = data[i] if i < len(data) else -1
            if kind == 0x42:
                self.g[0] = KANJI
            elif kind in (0x29, 0x2A, 0x2B):
                if i + 1 < len(data) and data[i + 1] == 0x42:
                    self.g[kind - 0x28] = KANJI
                    i += 1
        elif 0x28 <= nxt <= 0x2B and i + 1 < len(data):
            i += 1
            self.g[nxt - 0x28] = FINALS.get(data[i], self.g[nxt - 0x28])
        return i + 1

    def sign(self, data: bytes, i: int) -> tuple[str, int]:
        """The sign at i and the bytes it takes."""
        b = data[i]
        high = b & 0x80
        kind, code = self.g[self.right if high else self.left], b & 0x7F
        if kind == ALNUM:
            return chr(code), 1
        if kind != KANJI:
            if code >= 0x77:
                return (HIRAGANA_END if kind == HIRAGANA else KATAKANA_END)[code - 0x77], 1
            return two_byte(0x24 if kind == HIRAGANA else 0x25, code).replace("�", ""), 1
        second = data[i + 1] if i + 1 < len(data) else 0
        if second & 0x80 != high or not 0x21 <= second & 0x7F <= 0x7E:
            return "", 1
        if code >= 0x75:
            return self.table.get(code << 8 | second & 0x7F, ""), 2
        return two_byte(code, second & 0x7F), 2

    def plain(self, data: bytes, i: int) -> str:
        """The run of signs from i on that stand for themselves; empty if the set in use is not the one-byte alphabet."""
        run = PLAIN.match(data, i) if self.g[self.left] == ALNUM else None
        return run[0].decode("ascii") if run else ""

    def decode(self, data: bytes) -> str:
        out, i = [], 0
        while i < len(data):
            b = data[i]
            if b == 0x1B:
                i = self.escape(data, i + 1)
                continue
            if run := self.plain(data, i):
                out.append(run)
                i += len(run)
                continue
            step = 1
            if b in (0x0A, 0x0D):
                out.append("\n")
            elif b == 0x20:
                out.append(" ")
            elif b in (0x0E, 0x0F):
                self.left = 1 if b == 0x0E else 0
            elif 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFE:
                text, step = self.sign(data, i)
                out.append(text)
            i += step
        return "".join(out).strip()


def decode(data: bytes, more: dict[int, str] | None = None) -> str:
    return Decoder(extra_table(more)).decode(data)


@F.pandas_udf(StringType())
def decode_b24(data: pd.Series) -> pd.Series:
    """Text of a column of bytes."""
    table = extra_table()
    return data.map(lambda d: None if d is None else Decoder(table).decode(bytes(d)))
