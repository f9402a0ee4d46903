"""Word lists about captions and languages. All of it is fixed, public knowledge of the languages."""

from __future__ import annotations

# The ten languages by two-letter code, and the names, codes and spellings that mean them.
LANGUAGES = ["en", "zh", "de", "fr", "es", "ja", "ru", "ar", "hi", "th"]
LANGUAGE_NAMES = {
    "en": ["en", "eng", "english", "anglais", "englisch", "inglés", "英语", "英語", "английский"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "simplified chinese", "traditional chinese", "中文", "汉语", "漢語", "普通话", "简体中文", "繁體中文", "chinois", "chinesisch"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "德语"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "法语"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "西班牙语"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語", "日语", "japonais", "japanisch", "japonés"],
    "ru": ["ru", "rus", "russian", "русский", "russe", "russisch", "ruso", "俄语"],
    "ar": ["ar", "ara", "arb", "arabic", "العربية", "عربي", "arabe", "arabisch", "árabe", "阿拉伯语"],
    "hi": ["hi", "hin", "hindi", "हिन्दी", "हिंदी", "印地语"],
    "th": ["th", "tha", "thai", "ไทย", "ภาษาไทย", "thaï", "thailändisch", "泰语"],
}

# Hesitation sounds, in lower case.
FILLERS = {
    "en": ["uh", "um", "er", "ah", "hm", "hmm", "mm", "erm", "uhm", "eh", "oh", "mhm"],
    "de": ["äh", "ähm", "öh", "öhm", "hm", "hmm", "ehm", "tja"],
    "fr": ["euh", "heu", "hum", "bah", "ben", "hem", "hein"],
    "es": ["eh", "em", "mmm", "este", "ehm", "pues"],
    "ru": ["э", "ээ", "эм", "м", "мм", "ну", "эээ", "ммм", "хм"],
    "ar": ["اه", "آه", "امم", "اممم", "يعني", "إه", "أه", "اوه"],
    "hi": ["उम", "अं", "हम्म", "हूँ", "अम", "आं"],
    "th": ["เอ่อ", "อ่า", "อืม", "อือ", "เออ"],
    "zh": ["嗯", "唔", "呃", "啊", "额", "哦", "噢", "唉"],
    "ja": ["えーと", "ええと", "えっと", "うーん", "あの", "あのー", "えー", "んー", "まあ"],
}

# What sound annotations say, in lower case.
SOUNDS = {
    "en": ["music", "applause", "laughter", "laughs", "laughing", "inaudible", "unintelligible", "silence", "noise", "cough", "coughs", "coughing", "sigh", "sighs", "crosstalk", "cheering", "clapping", "background noise", "pause", "beep"],
    "de": ["musik", "beifall", "applaus", "gelächter", "lachen", "unverständlich", "stille", "geräusch", "husten", "seufzen"],
    "fr": ["musique", "applaudissements", "rires", "inaudible", "silence", "bruit", "toux", "soupir"],
    "es": ["música", "aplausos", "risas", "inaudible", "silencio", "ruido", "tos", "suspiro"],
    "ru": ["музыка", "аплодисменты", "смех", "неразборчиво", "тишина", "шум", "кашель", "вздох"],
    "ar": ["موسيقى", "تصفيق", "ضحك", "غير مسموع", "صمت", "ضوضاء", "سعال"],
    "hi": ["संगीत", "तालियाँ", "तालियां", "हँसी", "हंसी", "अस्पष्ट", "मौन", "शोर", "खांसी"],
    "th": ["ดนตรี", "เสียงปรบมือ", "เสียงหัวเราะ", "ฟังไม่ชัด", "เงียบ", "เสียงรบกวน", "เสียงดนตรี"],
    "zh": ["音乐", "掌声", "笑声", "听不清", "鼓掌", "静音", "沉默", "噪音", "咳嗽", "叹气", "大笑", "音樂", "掌聲", "笑聲", "聽不清"],
    "ja": ["音楽", "拍手", "笑い声", "笑い", "聞き取れず", "聞き取れない", "無音", "雑音", "咳", "ため息"],
}

# Words for a speaker before a number, in lower case.
SPEAKER_WORDS = ["speaker", "spk", "sprecher", "sprecherin", "locuteur", "locutrice", "intervenant", "hablante", "orador", "说话人", "發言人", "发言人", "話者", "спикер", "говорящий", "المتحدث", "متحدث", "वक्ता", "ผู้พูด", "person", "voice"]

# Titles that may stand before a name.
TITLES = ["dr", "prof", "mr", "mrs", "ms", "sir", "herr", "frau", "m", "mme", "mlle", "sr", "sra", "srta", "д-р", "г-н", "г-жа", "د", "डॉ", "श्री", "ดร", "คุณ"]

#: The languages a label can mean, by each spelling in lower case.
LANGUAGE_OF = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}


def language_of_label(label: str | None) -> str | None:
    """The two-letter code that a language label means; None if it names no language.

    Case, regions (``en-GB``, ``zh_Hans``, ``English (UK)``) and names in several languages are
    understood. A code of two or three letters that is not listed counts as some other language and
    comes back as it is.
    """
    if label is None:
        return None
    plain = label.strip().lower()
    if not plain:
        return None
    if plain in LANGUAGE_OF:
        return LANGUAGE_OF[plain]
    base = plain.split("(")[0].replace("_", "-").split("-")[0].strip()
    if base in LANGUAGE_OF:
        return LANGUAGE_OF[base]
    for word in plain.replace("(", " ").replace(")", " ").split():
        if len(word) > 3 and word in LANGUAGE_OF:
            return LANGUAGE_OF[word]
    if base in ("und", "unk", "n/a", "na", "none", "null", "mul", "zxx", "mis", "xx"):
        return None
    return base if base.isascii() and base.isalpha() and len(base) in (2, 3) else None
