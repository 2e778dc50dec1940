"""Language packs: word lists and patterns, which every operator takes as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, needed for equal results.
RU_STOP_WORDS = (
    "это что как все ещё или для над под при ну там тут вот так уже чтобы если потом тоже тогда даже сейчас теперь потому "
    "которые который которая которое когда можно нужно надо есть быть был была были будет будут нет да эт всё всех всем нам "
    "них мне меня нас ним ней свой свою свои своих его её ее также от до на за по в к с о об из у и а но не же ли бы то они "
    "оно она он моя мой моё моих ваш наш эта эти этих этого этому этой эту себя себе собой значит говорит"
).split()

# Abbreviations whose dot does not end a sentence.
RU_ABBREVIATIONS = (
    "т.е. т.д. т.п. т.к. т.н. г. гг. в. вв. р. руб. коп. млн. млрд. тыс. стр. см. ср. ул. пр. просп. пер. д. корп. кв. "
    "проф. акад. ред. тов. обл. респ. оз. вып. ч. т."
).split()

# Beginnings of words that point to problems.
RU_TRIGGERS = [
    "проблем", "риск", "нарушени", "несоответств", "наруш", "ошибк", "замечани", "претензи", "жалоб",
    "не успева", "не работа", "не подпис", "не соглас", "не дают", "не дал", "не разреш", "мешают", "блокиру",
    "не приня", "не выполн", "не включ", "не учтен", "не получ", "не предост", "не подтверж",
    "не понима", "не понял", "не ясн", "непонят", "не объясн", "не разъяс", "путан", "неразбер",
    "никак не", "никаких", "никто", "никого", "ничего не", "ничего не сооб",
    "штраф", "санкц", "пеня", "взыск", "конфликт", "спор", "суд", "иск", "убыток", "убытк", "потерял", "потери",
    "авари", "обман", "некачеств", "неисправ", "сомнен", "скрыт", "обход", "фальсиф", "подлог", "приписк", "поддел",
    "задержк", "опаздыва", "просрочк", "отстава", "сорвал", "сорван", "срыв",
    "скрыл", "не сообщил", "не предостав", "умалчив", "утаил", "утаив",
    "впервые", "всё равно", "пофиг", "похрен", "хренов", "тупой", "дурацк", "безобраз", "кошмар", "бардак", "беспоряд",
    "приказ", "распоряжен", "ответствен", "закреплён", "проверк", "ревиз", "аудит", "выискать", "ищем", "не можем найти",
]

# Interjections and particles that are no names.
RU_JUNK = (
    "угу ага эээ э-э э-э-э аэ а-а а-а-а хм хмм хы ну ой ах ох ого оп м-м ммм паша это тут там вот та то те ты вы мы он она "
    "они а о и у ы э я живи акую окую"
).split()
RU_VOWELS = "аеёиоуыэюя"

# Patterns of amounts, dates and numbers in words.
RU_AMOUNT = (
    r"\d+[\d\s.,]*\s*(?:%|процент|п\.п\.|млн|млрд|тыс|руб|лир|TL|долл|\$|€|евро|м[23]|кв\.м|км|тонн|т/ч|кВт|МВт|год[аов]?|кг|гр|"
    r"чел|раз|штук|шт|мин|час[аов]?|секунд|дн[ейя]|недел|месяц|суток|л\.)"
)
RU_DATE = (
    r"(?:\b\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b|\b(?:19|20)\d{2}\s*год[аов]?|январ[ья]|феврал[ья]|март[ае]?|апрел[ья]|ма[ея]|"
    r"июн[ья]|июл[ья]|август[ае]?|сентябр[ья]|октябр[ья]|ноябр[ья]|декабр[ья]|в понедельник|во вторник|в среду|в четверг|"
    r"в пятницу|в субботу|в воскресенье|сегодня|вчера|завтра|позавчера|на следующей|на этой неделе|в этом месяце|"
    r"в прошлом месяце|в этом квартале|в 1кварт|в [1-4]кв)"
)
RU_WORD_NUMBER = (
    r"\b(?:один|два|три|четыре|пят[ьи]|шест[ьи]|сем[ьи]|восем[ьи]|девят[ьи]|десят[ьи]|одиннадцат[ьи]|двенадцат[ьи]|"
    r"двадцат[ьи]|тридцат[ьи]|сорок|пятьдесят|сто|тысяч[аи])\s+(?:раз[аов]?|человек|лет|год[аов]?|дн[ейя]|недель|месяцев?|"
    r"час[аов]?|минут|процентов|миллионов|тысяч)"
)


@dataclass(frozen=True)
class Pack:
    """Everything an operator needs to know of a language."""

    stop_words: tuple[str, ...] = ()
    abbreviations: tuple[str, ...] = ()
    triggers: tuple[str, ...] = ()
    junk: tuple[str, ...] = ()
    vowels: str = "aeiouy"
    amount: str = r"\d+"
    date: str = r"\b\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?\b"
    word_number: str = r"\b(?:one|two|three)\s+(?:times|people)"


RUSSIAN = Pack(tuple(RU_STOP_WORDS), tuple(RU_ABBREVIATIONS), tuple(dict.fromkeys(RU_TRIGGERS)), tuple(RU_JUNK), RU_VOWELS, RU_AMOUNT, RU_DATE, RU_WORD_NUMBER)
#: For the driver's tables, whose prose is invented and in Latin script.
TEST = Pack(
    stop_words=("the", "and", "that", "was", "for", "are", "with", "und", "der", "die", "les", "des", "que", "los"),
    abbreviations=(), triggers=("thst", "erst", "ingly", "tionn", "schaft", "ment", "error", "risk"), junk=("the", "and"),
    amount=r"\d+[\d.,]*\s*(?:%|km|kg|ms|px|mb|gb|x|years?|days?|hours?)?")
