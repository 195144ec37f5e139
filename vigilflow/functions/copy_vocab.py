"""Words that briefs and lists of a card are put together from."""

# English.
VERBS_EN = ('reports', 'details', 'documents', 'describes', 'outlines')

URGENT_VERB_EN = 'warns of'

NOUNS_EN = {
    'phishing': 'a phishing campaign',
    'ransomware': 'a ransomware incident',
    'vulnerability': 'a newly disclosed vulnerability',
    'exploit': 'active exploitation of a vulnerability',
    'zero-day': 'a zero-day vulnerability',
    'breach': 'a data breach',
    'data leak': 'a data leak',
    'malware': 'a malware campaign',
    'spyware': 'a spyware operation',
    'scam': 'a scam campaign',
    'botnet': 'a botnet operation',
    'social engineering': 'a social-engineering campaign',
    'other': 'a cybersecurity incident',
    'default': 'a cybersecurity incident',
}

PLATFORM_PHRASE_EN = ' targeting {platforms}'

AUDIENCE_PHRASES_EN = {
    'normal_users': ' aimed at everyday users',
    'developers': ' aimed at developers',
    'sysadmins': ' hitting IT and sysadmins',
    'enterprise': ' against enterprise IT environments',
    'mobile_users': ' aimed at mobile users',
    'crypto_users': ' targeting crypto users',
}

AUDIENCE_NAMES_EN = {
    'normal_users': 'Everyday users',
    'developers': 'Developers',
    'sysadmins': 'IT / sysadmins',
    'enterprise': 'Enterprise IT teams',
    'mobile_users': 'Mobile users',
    'crypto_users': 'Crypto users',
}

ACTIONS_EN = ('Read the source article for the specifics', 'Apply patches and updates as your vendors release them')

# Ukrainian.
VERBS_UA = ('повідомляє про', 'описує', 'розповідає про', 'висвітлює', 'розбирає')

URGENT_VERB_UA = 'попереджає про'

NOUNS_UA = {
    'phishing': 'нову фішингову кампанію',
    'ransomware': 'інцидент із програмою-вимагачем',
    'vulnerability': 'щойно розкриту вразливість',
    'exploit': 'активну експлуатацію вразливості',
    'zero-day': 'вразливість нульового дня',
    'breach': 'витік даних',
    'data leak': 'оприлюднений набір зливних даних',
    'malware': 'кампанію зі шкідливим ПЗ',
    'spyware': 'операцію зі шпигунським ПЗ',
    'scam': 'шахрайську кампанію',
    'botnet': 'ботнет-операцію',
    'social engineering': 'кампанію соціальної інженерії',
    'other': 'інцидент кібербезпеки',
    'default': 'інцидент кібербезпеки',
}

PLATFORM_PHRASE_UA = ' проти {platforms}'

AUDIENCE_PHRASES_UA = {
    'normal_users': ' щодо звичайних користувачів',
    'developers': ' щодо розробників',
    'sysadmins': ' проти ІТ-адміністраторів',
    'enterprise': ' проти корпоративного ІТ',
    'mobile_users': ' щодо мобільних користувачів',
    'crypto_users': ' щодо криптокористувачів',
}

AUDIENCE_NAMES_UA = {
    'normal_users': 'Звичайні користувачі',
    'developers': 'Розробники',
    'sysadmins': 'ІТ-адміністратори',
    'enterprise': 'Корпоративні ІТ-команди',
    'mobile_users': 'Користувачі мобільних пристроїв',
    'crypto_users': 'Криптокористувачі',
}

ACTIONS_UA = ('Прочитайте оригінальну статтю для деталей', 'Встановлюйте патчі та оновлення, щойно їх випустить вендор')

# Whom a card concerns, by platforms, and where nothing tells.
USERS_OF = ' users'

ANYONE = 'Anyone following cybersecurity news'
