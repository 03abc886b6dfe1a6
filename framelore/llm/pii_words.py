"""Fixed values of the personal-information operator: word lists in natural order."""

# Given names by gender, in the language areas of the texts and the most common ones beyond.
GIVEN_F = frozenset(
    "amelie anna beatriz carla clara dorota elena emma eva fatima greta hanna hanne helena ilse irena ines jana julia laura lena lucia maria marta nadia nina noor olga paula petra rosa sanna sara sofia ulrike vera wanda zora".split()
    + "alice amanda angela barbara carmen catherine charlotte christine diana elizabeth emily francesca giulia hannah ingrid isabel jennifer jessica karen katarzyna linda lisa margaret mary mei michelle monika natalia patricia priya rachel rebecca sandra sarah sophie stephanie susan svetlana teresa yuki".split()
)
GIVEN_M = frozenset(
    "adam ahmed alexander anton bruno carlos clement david emil felix goran hugo ivan ivo jakob jan jonas jose karim karl kofi lars leon louis lukas marek mateo max michael milan nikolai omar oskar otto paul pedro peter rafael samuel simon stefan tariq thomas tomas viktor yusuf".split()
    + "andrew antonio benjamin charles christopher daniel diego edward eric fernando francesco george giovanni henry hiroshi james jean john joseph juan kenji kevin liam luca luis matthew mehmet mohammed noah oliver patrick pierre raj richard robert ryan sergei steven wei william".split()
)
# Given names that say no gender.
GIVEN_N = ["alex", "ariel", "charlie", "jamie", "jules", "kim", "lee", "mika", "noa", "quinn", "robin", "sam", "sascha", "toni"]
# Particles between given and family name.
PARTICLES = ["von der", "van der", "van den", "de la", "de los", "von", "van", "vom", "zu", "de", "del", "della", "di", "da", "dos", "du", "des", "el", "al", "bin", "ibn", "la", "le", "ter", "ten"]
# Endings of family names.
FAMILY_ENDS = [
    "shaw", "berg", "stad", "by", "mann", "sen", "son", "ikov", "dova", "ova", "ov", "ev", "etti", "elli", "anda", "quist", "ley", "wek", "oro", "rik", "ares", "ez", "inho", "oux", "kari", "inen", "ski", "ska",
    "sky", "wicz", "escu", "ino", "ini", "eau", "dottir", "ford", "ton", "well", "burg", "feld", "hoff", "stein", "bauer", "meier", "mayer", "er", "lund", "strom", "gren", "vik", "holm", "dahl",
]
# Words that follow a given name or an initial without being a family name.
NOT_NAMES = frozenset(
    """a an and are as asked at be before but by can der des die el for from has have he her his if in is it la le left les los not of off on or over per phoned relabelled said saw signs she so than that the then they
    this to under until was we were whether which who will with you after again never other order under after corner number never paper layer border center master water rather whether together however over ever every
    et est en dans der das den dem und oder mit von bei nach ist war im am y o con por que se fue
    mini large north south east west street road avenue lane close mews camera sensor""".split()
)
# Words before a whole name whose given name is not in the lists.
NAME_CUES = [
    "Miss", "Sir", "asked", "ask", "told", "tell", "contact", "contacted", "met", "thank", "thanked", "emailed", "reviewed by", "checked by", "annotated by", "labelled by", "signed by", "written by", "approved by", "sent by", "reported by", "Annotator", "annotator",
    "Reviewer", "reviewer", "colleague", "Kollegin", "Kollege", "fragen Sie", "geprüft von", "unterschrieben von", "demandez à", "relu par", "signé par", "pregunte a", "revisado por", "firmado por",
    "Ms", "Mr", "Mrs", "Dr.", "Prof.", "Herr", "Frau", "Mme", "Sr.", "Sra.", "Signed:", "Reviewed by", "author:", "According to", "Vendor contact:", "ask for", "Laut", "Selon", "Según", "Geprüft von", "Relu par", "Revisado por", "Rückfragen an", "Questions à", "Consultas a",
]
# Words after a whole name that only persons do.
NAME_VERBS = [
    "said", "says", "asked", "asks", "wrote", "writes", "told", "phoned", "reported", "thinks", "wants", "agreed", "signed", "reviewed", "approved", "noted", "replied", "answered", "confirmed", "explained", "sagt", "sagte", "fragt", "fragte", "schrieb", "meint", "unterschrieb",
    "dit", "a dit", "demande", "a demandé", "écrit", "a écrit", "a signé", "dijo", "dice", "preguntó", "escribió", "pidió", "firmó",
]
# Titles that tell a gender.
TITLES = {"f": ["ms", "mrs", "miss", "frau", "mme", "sra.", "señora", "madame"], "m": ["mr", "sir", "herr", "sr.", "señor", "monsieur"]}
# Family names in Han script, one sign each and the common ones of two.
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦傅方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔汤"
HAN_FAMILY_TWO = ["欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "司徒", "令狐", "长孙"]
# Words before and after a name in Han script.
HAN_BEFORE = ["请联系", "联系人", "联系", "联络", "询问", "咨询", "通知", "告诉", "感谢", "请问", "请找", "作者", "审核人", "负责人", "标注员", "姓名", "签名"]
HAN_AFTER = ["先生", "女士", "小姐", "老师", "经理", "主管", "同事", "说", "写道", "签字"]
# Signs of given names and places for surrogates in Han script.
HAN_GIVEN = {"f": "芳娜敏静丽艳娟霞秀兰玲红梅莉婷雪琳慧", "m": "伟强磊军洋勇杰涛明超刚平辉鹏华飞斌亮", "": "文宁安乐清晨嘉宇思远子涵"}
HAN_PLACES = "云青松竹梅溪湖桥泉岭峰谷岸洲港湾阳阴宁安兴隆丰盛"
# Words that announce a phone number.
PHONE_CUES = [
    "call", "phone", "phoned", "tel", "tel.", "telephone", "mobile", "mobile is", "cell", "fax", "reach me under", "reach me at", "contact", "fallback contact", "dial", "telefonisch unter", "telefon", "handy", "anrufen unter",
    "rufen sie", "mobil", "appelez le", "appeler le", "téléphone", "portable", "llamen al", "llame al", "llamar al", "teléfono", "móvil", "请拨打", "拨打", "电话", "手机", "致电", "phoned in from", "whatsapp", "sms",
]
# Words before numbers of things.
THING_NUMBERS = ["ticket", "frame ids", "frame id", "frame", "frames", "checksum", "batch", "run", "lot", "serial", "order no.", "order", "part number", "part no.", "asset tag", "invoice", "crop at", "offset", "scale", "version", "digest", "picture", "images", "ids", "sku", "model", "track", "ip"]
# Words that announce a number of a personal record.
ID_CUES = [
    "passport", "passport no.", "passport number", "driver licence", "driver license", "driver's licence", "driving licence", "licence", "social security no.", "social security number", "social security", "ssn", "national id", "national insurance",
    "tax number", "tax id", "tax no.", "personal number", "personal id", "id card", "identity card", "identity number", "lists id", "health insurance no.", "insurance no.", "ausweisnummer", "ausweis", "reisepass", "personalausweis", "führerschein",
    "steuernummer", "steuer-id", "sozialversicherungsnummer", "numéro d'identité", "numéro d’identité", "carte d'identité", "passeport", "permis de conduire", "numéro fiscal", "numéro de sécurité sociale", "documento de identidad", "dni", "nie",
    "nif", "pasaporte", "permiso de conducir", "licencia de conducir", "seguridad social", "身份证号码", "身份证号", "身份证", "护照号", "护照", "驾照", "社保号", "税号",
]
# Kinds of streets, by language.
STREETS_EN = ["street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "close", "mews", "boulevard", "blvd", "drive", "dr", "court", "ct", "square", "sq", "way", "terrace", "ter", "place", "pl", "crescent", "row", "hill", "walk", "gardens", "grove"]
STREETS_DE = ["straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig", "chaussee"]
STREETS_FR = ["rue", "avenue", "boulevard", "chemin", "quai", "place", "allée", "impasse", "route", "cours", "passage", "square"]
STREETS_ES = ["calle", "c/", "c.", "avenida", "avda.", "av.", "plaza", "paseo", "camino", "carrera", "ronda", "travesía"]
# Words of an address that are no names.
ADDRESS_WORDS = ["flat", "apt", "apartment", "unit", "suite", "bis", "ter", "quater", "de", "la", "los", "las", "del", "du", "des", "am", "an", "der", "im", "zum", "zur", "auf", "dem"]
# Last parts of file names that look like domains.
FILE_ENDS = frozenset("png jpg jpeg gif svg webp bmp tif tiff ico pdf json xml yaml yml txt csv zip gz py js css md".split())
# Syllables of made names, by script.
ONSETS = ["b", "br", "d", "dr", "f", "fl", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v", "w", "z"]
RIMES = ["a", "al", "an", "ar", "e", "el", "en", "er", "i", "il", "in", "is", "o", "ol", "on", "or", "u", "ul", "un", "ur"]
SYLLABLES = {
    "latin": (ONSETS, RIMES),
    "cyrillic": (["б", "бр", "в", "г", "гр", "д", "др", "ж", "з", "к", "кр", "л", "м", "н", "п", "р", "с", "ст", "т", "тр", "ф", "х"], ["а", "ан", "ар", "е", "ен", "и", "ин", "о", "ол", "он", "ор", "у", "ун"]),
    "greek": (["β", "γ", "δ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "στ", "τ", "τρ", "φ", "χ"], ["α", "αν", "αρ", "ε", "ελ", "ι", "ιν", "ο", "ολ", "ον", "ου"]),
}
GIVEN_BY_SCRIPT = {
    "cyrillic": {"f": ["анна", "вера", "ирина", "мария", "нина", "ольга"], "m": ["антон", "иван", "лев", "олег", "павел", "юрий"], "": ["саша", "женя", "валя"]},
    "greek": {"f": ["άννα", "ελένη", "μαρία", "σοφία"], "m": ["γιώργος", "νίκος", "πέτρος", "κώστας"], "": ["άλεξ", "νάγια"]},
}
