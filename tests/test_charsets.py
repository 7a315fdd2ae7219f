"""Round trips of every character set on texts of its languages."""

import pytest

from lumenquarry.functions.charsets import charset, decoded_text
from lumenquarry.operators.binary import decode_bytes

TEXTS = {
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。这是我们的国家和人民说的。",
    "tw": "人人生而自由,在尊嚴和權利上一律平等。他們賦有理性和良心,並應以兄弟關係的精神相對待。這是我們的國家和人民說的。",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ça va être drôle à l’été, où ?",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Größe, Übermut, „schön“.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos. ¿Qué pasó mañana? ¡Ay, niño!",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Não há razões, irmãos.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. På åar och öar.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Żółć, gęś, łoś.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Příliš žluťoučký kůň.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Őrült tűzfűtő.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Işığı gören çığlık.",
}
SETS = {
    "ru": ["windows-1251", "koi8-r", "iso8859-5", "cp866"], "el": ["windows-1253"], "he": ["windows-1255"], "ar": ["windows-1256"], "th": ["cp874"], "ja": ["shift_jis", "euc_jp"], "ko": ["euc_kr"], "zh": ["gb18030"], "tw": ["big5"],
    "fr": ["windows-1252"], "de": ["windows-1252"], "es": ["windows-1252"], "pt": ["windows-1252"], "sv": ["windows-1252"], "pl": ["windows-1250"], "cs": ["windows-1250"], "hu": ["windows-1250"], "tr": ["windows-1254"],
}


@pytest.mark.parametrize("lang", sorted(SETS))
def test_round_trips(lang):
    for name in SETS[lang]:
        for text in (TEXTS[lang], TEXTS[lang] * 40, "plain ascii words come first. " + TEXTS[lang], TEXTS[lang].upper() if lang in ("ru", "el") and name != "cp866" else TEXTS[lang]):
            assert decoded_text(text.encode(name))[0] == text, (lang, name, charset(text.encode(name)))
    for name in ("utf-8", "utf-8-sig", "utf-16"):
        assert decode_bytes(TEXTS[lang].encode(name)) == TEXTS[lang]


def test_little_evidence():
    assert charset(b"") == charset(b"ascii") == "utf-8"
    assert decode_bytes("café".encode("windows-1252")) == "café" and decode_bytes(b"\xe9") == "é" and decode_bytes(b"a\x81b\xff") == "a�bÿ"
    assert decode_bytes("naïve – “quoted” £5".encode("windows-1252")) == "naïve – “quoted” £5"
    broken = TEXTS["ja"].encode("shift_jis")[:-1] + b"\xff"
    assert isinstance(decode_bytes(broken), str)
    assert decode_bytes(TEXTS["ru"].encode("windows-1251") * 20_000) == TEXTS["ru"] * 20_000
