"""Patterns and word lists of editorial checks; they decide results."""

# Sentences without content, as regular expressions (case-insensitive).
FLUFF_EN = (
    r'''\bstay\s+vigilant\b''',
    r'''\bremain\s+vigilant\b''',
    r'''\bremain\s+cautious\b''',
    r'''\bremain\s+aware\b''',
    r'''\bin\s+today'?s\s+(?:digital|evolving|complex|connected)\s+(?:landscape|world|environment|age)\b''',
    r'''\bever[- ]evolving\s+(?:threat\s+)?landscape\b''',
    r'''\bcybersecurity\s+is\s+(?:more\s+)?important(?:\s+than\s+ever)?\b''',
    r'''\bhighlights?\s+the\s+(?:importance|need|critical(?:ity|\s+nature))\b''',
    r'''\bunderscores?\s+the\s+(?:importance|need)\b''',
    r'''\bproactive\s+(?:steps?|measures?|approach)\s+to\b''',
    r'''\bserves?\s+as\s+a\s+reminder\b''',
    r'''\b(?:good|strong|proper)\s+cyber\s+hygiene\b''',
    r'''\brobust\s+security\s+posture\b''',
    r'''\bessential\s+to\s+(?:maintain|protect|safeguard)\b''',
    r'''\bin\s+the\s+current\s+threat\s+environment\b''',
    r'''\bbe\s+(?:more\s+)?cautious\s+(?:of|about|when)\b''',
    r'''\bthis\s+(?:incident\s+)?(?:emphasizes|reinforces|reminds)\b''',
    r'''\btestament\s+to\s+''',
    r'''\bpivotal\s+moment\b''',
    r'''\bwatershed\s+moment\b''',
    r'''\bindelible\s+mark\b''',
    r'''\bsea\s+change\b''',
    r'''\bmark(?:s|ed)?\s+a\s+(?:significant|pivotal|major)\s+(?:shift|moment|turning)\b''',
    r'''\bat\s+its\s+core,?\s''',
    r'''\bthe\s+real\s+question\s+is\b''',
    r'''\bthe\s+heart\s+of\s+the\s+matter\b''',
    r'''\bwhat\s+really\s+matters\s+is\b''',
    r'''\bthe\s+future\s+looks\s+bright\b''',
    r'''\bexciting\s+times\s+(?:lie\s+)?ahead\b''',
    r'''\bstep\s+in\s+the\s+right\s+direction\b''',
    r'''\bonly\s+time\s+will\s+tell\b''',
    r'''\bas\s+of\s+my\s+(?:last\s+)?(?:training|knowledge|update)\b''',
    r'''\bbased\s+on\s+(?:the\s+)?available\s+information\b''',
    r'''\bwhile\s+specific\s+details\s+are\s+limited\b''',
    r'''\bI\s+hope\s+this\s+helps\b''',
    r'''\b(?:certainly|of\s+course)!''',
    r'''\bgreat\s+question\b''',
    r'''\blet\s+me\s+know\s+if\b''',
    r'''\bwithout\s+further\s+ado\b''',
)

FLUFF_UA = (
    r'''важливо\s+(?:залишатися|бути|зберігати)\s+пильн''',
    r'''у\s+сучасному\s+(?:цифровому|складному|стрімкому)\s+(?:світі|просторі|середовищі)''',
    r'''у\s+сучасному\s+ландшафті\s+загроз''',
    r'''важливіст(?:ь|ю)\s+кібербезпек''',
    r'''користувачам\s+(?:варто|необхідно|слід|потрібно)\s+бути\s+(?:уважн|обережн|пильн)''',
    r'''необхідно\s+(?:зберігати|підтримувати|зміцнювати)\s+пильність''',
    r'''підкреслює\s+(?:важливість|необхідність|критичність)''',
    r'''наголошує\s+на\s+важливост''',
    r'''кіберг(?:і|и)гієн''',
    r'''служить\s+нагадуванням''',
    r'''посилює\s+необхідність''',
    r'''(?:гарн|надійн)а\s+позиція\s+(?:з\s+)?безпек''',
    r'''(?:знаковий|поворотний|переломний)\s+момент''',
    r'''віхов(?:ий|а|е)\s+(?:момент|подія)''',
    r'''справжн(?:ій|я)\s+(?:прорив|злам)''',
    r'''по\s+суті,''',
    r'''справжн(?:є|е)\s+питання''',
    r'''у\s+самому\s+центрі\s+питання''',
    r'''майбутнє\s+виглядає\s+(?:яскрав|обнадійлив)''',
    r'''крок\s+у\s+правильному\s+напрямку''',
    r'''час\s+покаже''',
    r'''станом\s+на\s+(?:моє\s+)?останнє\s+(?:оновлення|навчання)''',
    r'''на\s+основі\s+доступної\s+інформації''',
    r'''сподіваю(?:сь|ся),?\s+це\s+допоможе''',
    r'''звичайно!''',
    r'''чудове\s+питання''',
    r'''без\s+зайвих\s+слів''',
)

ADVICE_EN = (
    r'''\bimprove\s+(?:your\s+)?security\s+posture\b''',
    r'''\b(?:maintain|practice|ensure)\s+(?:good\s+)?(?:cyber\s+)?hygiene\b''',
    r'''\bstay\s+safe\s+online\b''',
    r'''\bstay\s+vigilant\b''',
    r'''\bremain\s+(?:vigilant|cautious|aware)\b''',
    r'''\bbe\s+(?:more\s+)?cautious\b''',
    r'''\bconsider\s+implementing\b''',
    r'''\bevaluate\s+your\s+security\b''',
    r'''\breview\s+your\s+security\s+practices?\b''',
    r'''\bexercise\s+caution\b''',
    r'''\btake\s+proactive\s+steps?\b''',
    r'''\bstrengthen\s+(?:your\s+)?(?:overall\s+)?security\s+posture\b''',
    r'''\bensure\s+(?:strong\s+)?security\s+measures\b''',
    r'''\bbe\s+aware\s+of\s+phishing\s+attempts\b''',
)

ADVICE_UA = (
    r'''будьте\s+(?:обережн|пильн|уважн)''',
    r'''залишайтеся\s+(?:пильн|обережн|уважн)''',
    r'''дотримуйтеся\s+(?:правил\s+)?кіберг(?:і|и)гієн''',
    r'''перегляньте\s+практики\s+безпек''',
    r'''посил(?:ьте|юйте)\s+(?:свій\s+)?захист''',
    r'''будьте\s+уваж(?:ні|ним)\s+(?:до|щодо|з)\s+фішинг''',
    r'''оцініть\s+стан\s+безпек''',
    r'''вживайте\s+проактивних\s+заходів''',
    r'''забезпечте\s+належний\s+рівень\s+безпек''',
)

# clichés, as substrings of lower-case text.
CLICHES_EN = (
    'evolving threat landscape', 'evolving cyber threat', 'threat landscape', "in today's digital",
    "in today's evolving", 'robust security posture', 'robust cybersecurity posture', 'leverages cutting-edge',
    'best-in-class', 'navigate the complex', 'malicious actors may leverage', 'malicious actors can leverage',
    'cybercriminals increasingly', 'could allow attackers to gain elevated privileges and compromise',
    'this is a classic', 'that means access to every', 'stay vigilant', 'be cautious', 'maintain good cyber hygiene',
    'maintain cyber hygiene', 'follow vendor recommendations', 'follow best practices', 'review your security posture',
    'implement defense in depth', 'educate users', "let's break down", 'it is important to note', 'in conclusion',
    'understanding this attack', 'in summary', 'furthermore', 'as an ai', 'i cannot', "i'm sorry",
    'as a language model',
)

CLICHES_UA = (
    'у сучасному ландшафті', 'сучасний ландшафт загроз', 'ландшафт загроз', 'надійна позиція з безпеки',
    'комплексний підхід', 'зловмисники все частіше', 'зловмисники можуть використовувати', 'класичний сценарій',
    'будьте пильними', 'дотримуйтеся кібергігієни', 'дотримуйтесь кібергігієни', 'навчайте користувачів',
    'дотримуйтеся рекомендацій вендора', 'дотримуйтесь рекомендацій вендора', 'розглянемо, як працює',
    'розглянемо як працює', 'важливо зазначити', 'на завершення', 'більш того', 'як ші', 'як штучний інтелект',
    'я не можу',
)

# Words to replace by the stem they begin with, and stems that don't belong in Ukrainian.
GLOSSARY = {
    'уязвим': 'вразлив',
    'взлом': 'злам',
    'мошенн': 'шахрайн',
    'мошенниче': 'шахрайство',
    'учётн': 'обліков',
    'учетн': 'обліков',
    'пользовател': 'користувач',
    'вредон': 'шкідлив',
    'обнаруж': 'виявл',
    'находитс': 'перебува',
    'являетс': 'є ',
    'являютс': 'є ',
    'только что': 'щойно',
    'путём': 'шляхом',
    'путем': 'шляхом',
    'одной': 'однієї',
    'другой': 'іншої',
    'получит': 'отрима',
    'сообщ': 'повідомл',
    'сейчас': 'зараз',
    'правильн': 'правильн',
    'опасн': 'небезпечн',
    'защит': 'захист',
    'поддержк': 'підтримк',
    'атак': 'атак',
    'хищен': 'крадіжк',
    'перехват': 'перехопл',
    'нульден': 'нульовий ден',
    '0-ден': 'нульовий ден',
    '0ден': 'нульовий ден',
    'витікам': 'витоку',
    'витоків': 'витоку',
}

RUSSISMS = (
    'уязв', 'взлом', 'мошен', 'учетн', 'учётн', 'являетс', 'являютс', 'обнаруж', 'только что', 'путем', 'путём',
    'вредон', 'находитс',
)

# Stop words of paragraph comparison, and acronyms that keep their capitals.
PARAGRAPH_STOPWORDS_EN = (
    'the', 'a', 'an', 'of', 'to', 'in', 'on', 'for', 'and', 'or', 'but', 'is', 'are', 'was', 'were', 'be', 'been', 'by',
    'as', 'at', 'from', 'that', 'this', 'it', 'its', 'their', 'they', 'with', 'into', 'after', 'before', 'than', 'then',
    'if', 'when', 'while', 'have', 'has', 'had',
)

PARAGRAPH_STOPWORDS_UA = (
    'і', 'й', 'та', 'у', 'в', 'на', 'з', 'із', 'за', 'до', 'від', 'по', 'що', 'як', 'це', 'цей', 'ця', 'цьому', 'така',
    'такий', 'так', 'не', 'ні', 'або', 'чи', 'але', 'бо', 'тому', 'коли', 'де', 'хто', 'які', 'який', 'яка', 'якого',
    'якій', 'був', 'була', 'було', 'буде',
)

ACRONYMS = (
    'AI', 'API', 'APT', 'AWS', 'BIOS', 'CISA', 'CVE', 'DDoS', 'DNS', 'FBI', 'GPU', 'HTTP', 'HTTPS', 'ICS', 'IoT', 'IP',
    'JS', 'JSON', 'LDAP', 'MFA', 'NSA', 'OAuth', 'OS', 'OTP', 'PDF', 'PHP', 'PIN', 'RAM', 'RCE', 'RDP', 'SDK', 'SMS',
    'SQL', 'SSH', 'SSL', 'TLS', 'UEFI', 'URL', 'USB', 'VPN', 'XML', 'XSS', '2FA',
)

# Hosts that are read through a proxy.
PROXIED_HOSTS = ('www.cisa.gov', 'ain.ua', 'dev.ua')


# Fixed value: how a byline begins.
BYLINE = r"(?iU)^\s*(?:by\s+\S+|posted\s+by\s+\S+|on\s+\w+\s+\d{1,2},?\s*\d{4})\b"

# What a provider is told of an item: characters of the body, what stands behind a cut one, ends of sentences in
# the order in which they are tried, names of audiences, the last line.
PROMPT_BODY = 1200
PROMPT_CUT = "[…truncated]"
PROMPT_ENDS = (". ", "! ", "? ", ".\n", "!\n", "?\n")
PROMPT_AUDIENCES = {
    "normal_users": "Everyday users",
    "developers": "Developers",
    "sysadmins": "IT / sysadmins",
    "enterprise": "Enterprise IT",
    "mobile_users": "Mobile users",
    "crypto_users": "Crypto users",
    "general": "Anyone following cybersecurity",
}
PROMPT_CLOSE = "\nProduce the structured threat post."

# Headings of the prompts.
PROMPT_STYLE = "STYLE NOTES:\n"
PROMPT_GUIDANCE = "EXTRA GUIDANCE:\n"
PROMPT_TEMPLATE = "TEMPLATE_ID: "
PROMPT_LANGUAGE = "OUTPUT_LANGUAGE: "
PROMPT_FACTS = "SOURCE METADATA\n"
PROMPT_TITLE = "\nSOURCE ARTICLE\nTitle: "
PROMPT_TEXT = "\nBody:\n"
