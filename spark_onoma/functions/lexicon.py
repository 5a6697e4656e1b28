"""Name tables. Each is a default that callers can extend or replace through the options."""

from __future__ import annotations

# Titles, and those of them that are names too.
TITLES = frozenset("mr mrs ms miss mx dr doctor prof professor rev reverend fr father sr sister br brother hon honorable honourable judge justice sir dame lord lady capt captain col colonel gen general lt lieutenant maj major sgt sergeant cmdr commander adm admiral pvt engr er adv advocate shri sri smt kum thiru sheikh shaikh syed sayyid hafiz imam maulana pandit swami baba haji alhaji don dona sra srta herr frau monsieur madame mlle mme ing lic the".split())
AMBIGUOUS_TITLES = frozenset("gen maj sr br don dona the sheikh shaikh syed sayyid sri shri baba er lord lady sister father imam".split())
# Suffixes, those that are names or initials too, and generational ones with their canonical form.
SUFFIXES = frozenset("jr jnr junior sr snr senior ii iii iv vi vii viii ix phd dphil md do dds dmd dvm jd llb llm esq esquire cpa mba msc bsc bs ba ma rn np pe pmp cfa ret retd usa usmc usn usaf".split())
AMBIGUOUS_SUFFIXES = frozenset("md do ma ba bs np pe rn ii vi usa".split())
GENERATIONS = {"jr": "jr", "jnr": "jr", "junior": "jr", "sr": "sr", "snr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "v": "v", "vi": "vi", "vii": "vii", "viii": "viii", "ix": "ix"}
# Family-name particles, and those that bind only to a word of three letters or more.
PARTICLES = frozenset("de del dela della delle dello degli dei di da das dos do du des la le les lo van von vander vanden ver ten ter den der het op aan af av zu zum zur el al abu abd bin ibn bint ben bar mac mc nic ni ap san santa santos st saint sainte ste ka te oz".split())
WEAK_PARTICLES = frozenset("do la le el al ben bar ni te ka oz ap st san".split())

# Our own selection of common short forms by full name; a member of two groups links both only to itself.
NICKNAMES = """
robert bob rob bobby robbie|william will bill billy liam|richard rick dick rich|james jim jimmy jamie|john jack johnny|margaret peggy maggie meg greta
elizabeth liz beth betty eliza lizzie|mary polly molly|ann nancy annie nan|nathan nate|nathaniel nate nat|katherine kate kathy katie kat|steven steve
thomas tom tommy|michael mike mick mickey|charles charlie chuck|edward ed eddie ted ned|henry harry hank|joseph joe joey|daniel dan danny
david dave davy|matthew matt|andrew andy drew|anthony tony|christopher chris kit|patrick pat paddy|patricia pat patty trish|samuel sam sammy
benjamin ben benny|alexander alex sandy|timothy tim|gregory greg|jeffrey jeff|kenneth ken kenny|lawrence larry|leonard leo len lenny
peter pete|philip phil|raymond ray|ronald ron ronnie|stephen steve|theodore ted theo|victoria vicky|susan sue susie|sarah sally sadie
rebecca becky|jennifer jenny jen|jessica jess|deborah deb debbie|dorothy dot dolly|frances fran frankie|francis frank|barbara barb|catherine cathy kate
"""
VARIANTS = """
john jon|steven stephen stefan|katherine catherine kathryn katharine|sara sarah|eric erik|philip phillip|jeffrey geoffrey
ann anne|marc mark|carl karl|allan alan allen|lewis louis|lakshmi laxmi|suresh sureesh|krishna krsna|hussain hussein husain
ahmed ahmad|ali aly|yousef yusuf youssef|mcdonald macdonald|obrien brien|schmidt schmitt|meyer meier maier mayer|vijay vijai|sharma sarma
"""
TRANSLATIONS = "john jean juan giovanni johann ivan|peter pierre pedro pietro petr|james jacques diego giacomo|michael michel miguel michele mikhail|paul paolo pablo pavel|mary marie maria"
TRANSLITERATIONS = "geetha geeta|mohammad mohammed muhammad mohamed|sergei sergey serguei|aleksandr alexander|dmitry dmitri dimitri|yuri yury iouri|tchaikovsky chaikovsky|khaled khalid|rahman rehman|abdul abdel|qasim kassim"
ROMANISATIONS = "zhang chang|li lee|wang wong|chen chan|zhao chao|xu hsu|huang hwang|liu lau"
STRENGTH = {"nickname": 0.9, "variant": 0.97, "translation": 0.55, "transliteration": 0.96, "romanisation": 0.62, "custom": 0.92}

# Written short forms, and short names that are never cut from longer ones.
_MOHAMMAD = ("mohammad", "muhammad", "mohammed")
CONTRACTIONS = {"mohd": _MOHAMMAD, "muhd": _MOHAMMAD, "mhd": _MOHAMMAD, "md": _MOHAMMAD, "wm": ("william",), "robt": ("robert",), "richd": ("richard",), "jno": ("john",), "jas": ("james",), "jos": ("joseph",), "geo": ("george",), "thos": ("thomas",), "chas": ("charles",), "benj": ("benjamin",), "danl": ("daniel",), "edwd": ("edward",), "saml": ("samuel",), "alexr": ("alexander",), "eliz": ("elizabeth",), "marg": ("margaret",), "kath": ("katherine", "catherine"), "xtopher": ("christopher",), "xpher": ("christopher",)}
STANDALONE = frozenset("raj ram ravi ali ana anna jan sam max ben dan don ron tom tim jim joe ken leo lee roy ray rex guy ian eve amy joy kim kai omar noor rani devi mina gita asha usha lata nina rita sita maya mark marc paul carl karl erik eric alan adam noah liam luca hugo juan jose luis ivan igor oleg boris pablo diego chen wang li lin park han jin yan ann anne jane john jon ted bob rob bill will nick rick mike dave greg jeff todd chad kyle sean ryan dean glen neil earl gary jerry larry barry harry terry perry kerry amit ajay arun anil atul ashok vinod vijay sunil".split())

# Our own selection of look-alikes that are different names.
DISTINCT_PAIRS = """
michael michelle|wei li|zhang chang|john jean|jose josef|andrea andrew|amit ajit|raj rajesh|eric erica|daniel danielle|paul paula
carol carl|brian ryan|erin eric|maria mario|julia julian|christine christian|robert roberta|martin martina|karen karan|anita amita|sunil sushil|rohan rohit|gabriel gabrielle|nicholas nicole|patrick patricia|stephen stephanie|christopher christina|adrian adriana|simon simone|carl carla|joan jean|jon jan|christian christina|louis louise|henry henrietta|george georgia|victor victoria|francis frances|marc marco|alex alexa
aarav arnav|kamal kamala|rajesh rakesh|ramesh suresh|mahesh mukesh|dinesh ganesh|lisa luisa|joan john|dan ian|jane jan|tina gina|mona nona|sam pam|amit sumit
"""
# Our own selection of common given and family names; the first few of each count as very common.
GIVEN = "john james robert michael william david mary mohammad maria anna ram raj jose wei richard joseph thomas charles daniel matthew anthony mark steven paul andrew peter patrick george kenneth edward brian kevin jason eric stephen larry justin scott brandon benjamin samuel frank gregory raymond alexander jack dennis jerry tyler aaron henry adam douglas nathan zachary kyle walter patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela shirley brenda pamela nicole katherine samantha christine emma catherine virginia rachel erik carlos luis juan pedro miguel sofia lucia elena olga ivan sergei dmitry natalia tatiana hans peter klaus fritz heinrich karl greta ingrid lars sven bjorn giovanni marco luca paolo francesca giulia chiara pierre jean jacques francois claude camille chloe manon amelie priya anjali deepak sunil anil vijay sanjay ravi suresh ramesh mahesh rajesh rakesh amit rohit rahul neha pooja sunita geeta lakshmi krishna arjun vikram ali omar hassan hussain ahmed fatima aisha khalid yusuf ibrahim ming fang li jun lei yan hiroshi kenji yuki akira janet carolyn polly peggy kate nate rahul amit priya rajesh suresh ramesh sunita deepak deepika anil vijay sanjay geetha lakshmi mohan krishna abdul ahmed ali hassan omar jean pierre marie luis carlos juan ana sofia jan hans karl ivan olga anup rajiv riya satyendra ajay mahendra sagar".split()
FAMILY = "smith kumar singh lee wang khan johnson garcia nguyen patel williams brown jones miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres hill flores green adams nelson baker hall rivera campbell mitchell carter roberts sharma verma gupta shah yadav reddy iyer menon nair das devi rahman hussain ahmed ali li zhang chen liu yang huang zhao wu zhou xu sun ma chang brooks foster rogers sah".split()
VERY_COMMON = 16

# Letters that canonical decomposition leaves whole, and their spelling.
ATOMIC_LETTERS = {"ß": "ss", "ẞ": "SS", "ø": "o", "Ø": "O", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ħ": "h", "Ħ": "H", "ı": "i", "İ": "I", "ŉ": "n", "ŋ": "n", "Ŋ": "N", "ŧ": "t", "Ŧ": "T", "ĸ": "k", "ſ": "s", "ƒ": "f", "ǅ": "dz", "ǆ": "dz", "ǳ": "dz", "ǈ": "lj", "ǉ": "lj", "ǋ": "nj", "ǌ": "nj"}

# Romanisation by letter.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i yi ye g".split(" "), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
GREEK_PAIRS = {"ου": "ou", "αυ": "av", "ευ": "ev", "μπ": "b", "ντ": "nt", "γκ": "g", "τζ": "tz", "αι": "ai", "ει": "ei", "οι": "oi", "γγ": "ng", "τσ": "ts"}
HEBREW = dict(zip("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "a b g d h v z ch t y k k l m m n n s a p p ts ts k r sh t".split(), strict=True))
ARABIC = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويءأإآىةئؤ", "a b t th j h kh d dh r z s sh s d t z a gh f q k l m n h w y  a i a a a y w".split(" "), strict=True))
DEVANAGARI_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split(), strict=True))
DEVANAGARI_VOWELS = dict(zip("अआइईउऊऋएऐओऔ", "a a i i u u ri e ai o au".split(), strict=True))
DEVANAGARI_SIGNS = dict(zip("ािीुूृेैोौॉॅ", "a i i u u ri e ai o au o e".split(), strict=True))
NUKTA = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f"}
HAN = dict(zip("王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何高林罗羅郑鄭梁伟偉芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华文", "wang li zhang zhang liu liu chen chen yang yang huang huang zhao zhao wu wu zhou xu sun sun ma ma zhu hu guo he gao lin luo luo zheng zheng liang wei wei fang na min jing li qiang lei jun yang yong yan jie juan tao ming chao xiu xia ping gang gui ying hua wen".split(), strict=True))
WORDS = {"राहुल": "rahul", "शर्मा": "sharma", "सिंह": "singh", "कुमार": "kumar", "सत्येंद्र": "satyendra", "सागर": "sagar", "محمد": "muhammad", "علي": "ali", "أحمد": "ahmad", "حسن": "hassan", "عبد": "abd", "الله": "allah", "فاطمة": "fatima", "خالد": "khalid", "Петров": "petrov", "Иван": "ivan", "Сергей": "sergei", "Александр": "aleksandr"}

# Code point ranges by script.
SCRIPTS = {
    "latin": "A-Za-zªºÀ-ɏḀ-ỿⱠ-Ɀ꜠-ꟿﬀ-ﬆＡ-Ｚａ-ｚ",
    "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯⷠ-ⷿꙀ-ꚟ", "hebrew": "֐-׿יִ-ﭏ", "arabic": "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻾",
    "devanagari": "ऀ-ॿ꣠-ꣿ", "bengali": "ঀ-৿", "gurmukhi": "਀-੿", "gujarati": "઀-૿", "tamil": "஀-௿", "telugu": "ఀ-౿", "thai": "฀-๿", "hangul": "ᄀ-ᇿ㄰-㆏가-힯", "kana": "぀-ヿㇰ-ㇿ", "han": "㐀-䶿一-鿿豈-﫿",
}
NEUTRAL = "\u0000-@\\[-`{-©«-¹»-¿ -⁯︀-️"


def groups(text: str) -> list[list[str]]:
    return [g.split() for line in text.strip().split("\n") for g in line.split("|")]
