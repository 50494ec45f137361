"""Words of personal names: fixed lists and how a word counts."""

from __future__ import annotations

import re
from functools import lru_cache

from .folding import fold

#: Common given names, in their usual spelling.
GIVEN = """
Abdullah Adem Adnan Ahmet Ali Alper Arda Arif Arzu Asiye Aslı Ayhan Ayla Aylin Aynur Aysel Aysun Ayşe Ayten Aziz Banu Barış Bayram Begüm Bekir Belgin Berna Beyza Bilal Birol Bülent Burak Burcu
Büşra Cafer Can Canan Celal Cemal Cemil Cengiz Ceren Cevdet Çağla Çetin Çiğdem Cihan Damla Deniz Derya Dilek Durmuş Dursun Ebru Ece Elif Emel Emin Emine Emrah Emre Enver Ercan Erdal Erdem Erdoğan Eren Erhan Erkan
Erol Esin Esra Eyüp Faruk Fatih Fatma Ferhat Feride Fevzi Figen Fikret Filiz Funda Gamze Gizem Gökhan Gönül Gül Gülay Gülcan Gülsüm Güler Hacer Hakan Haldun Halil Halime Hamza Harun Hasan Hatice Havva
Hayriye Hülya Hüseyin İbrahim İlhan İlknur İsmail İsmet Kadir Kadriye Kamil Kemal Kenan Kerem Kübra Leyla Levent Mahmut Mehmet Melahat Melek Meral Merve Meryem Metin Mine Muhammet Murat Musa Mustafa Muzaffer Naci
Nazlı Nazmiye Necati Necla Neriman Nermin Nesrin Nevin Nihat Nilgün Nuray Nurgül Nuri Nurten Onur Orhan Osman Ömer Özge Özgür Özlem Perihan Pınar Ramazan Recep Rıza Rukiye Saadet Salih Sami Sedat Selçuk Selim Selma Semra Serap Serdar
Serkan Sevda Sevgi Sevim Sibel Sinan Songül Süleyman Şaban Şenol Şerife Şükrü Tahsin Tamer Tuncay Tülay Turgut Uğur Ümit Vedat Veli Volkan Yaşar Yavuz Yıldız Yusuf Zafer Zehra Zekeriya Zeliha Zeynep Ziya
""".split()
#: Pet forms of given names that no short rule gives.
PETS = "Emoş Fatoş Hatçe İbo Mıstık Memo Zeyno Muro Fero Taho Meri Sülo Ramo Şero Ayşoş Gülo Haso Kemo Meyro Apo Neco Osi Hüso Peri".split()
#: Folded stems of things that are named after persons, and of places.
THINGS = """park cadde cad cd sokak sokag sok sk bulvar blv mahalle mah mh meydan ilkokul ortaokul anaokul okul lise universite fakulte enstitu yuksekokul kultur sanat merkez cami mescit hastane poliklinik kutuphane stad spor
kopru yurd yurt vakf vakif dernek salon tesis site apartman apt blok koy mezarlik carsi anit muze tiyatro kres havaliman istasyon durag durak baraj orman koru bahce cesme hamam otel ilkogretim anadolu fen meslek egitim
genclik sahne konferans havuz liman iskele pazar hal hali kavsak yol tunel evi ilce ilcesi beldesi semt kulup ormani kosk konak plaj""".split()
#: Folded words that are no surname: offices and posts, labels, address and function words.
NO_SURNAME = frozenset(
    """bey beyin beye hanim hanimin hanima abla abi agabey efendi hoca usta sayin sn av dr prof doc op uzm muh sef sefi uzman uzmani memur memuru mudur muduru mudurlugu mudurlugune mudurluk baskan baskani baskanligi baskanligina
    baskanlik yardimci yardimcisi raportor komisyon kurul kurulu uye uyesi birim birimi genel sekreter sekreteri daire dairesi sube subesi muhendis muhendisi tekniker teknisyen avukat doktor ogretmen veznedar denetci mufettis
    katip zabit amir amiri amirligi sorumlu sorumlusu yetkili yetkilisi vali vali kaymakam kaymakami kaymakamligi kaymakamligina valiligi valiligine belediye belediyesi bakanligi bakanlik imza adres adresi tel telefon telefonu
    faks cep gsm eposta posta mail kimlik no numara numarasi tarih tarihi konu konusu sayi sayisi ilgi ek ekler dagitim geregi bilgi dahili ankara istanbul turkiye tc cumhuriyeti ocak subat mart nisan mayis haziran temmuz agustos
    eylul ekim kasim aralik pazartesi sali carsamba persembe cuma cumartesi ve veya ile icin olan olarak adina tarafindan adli isimli bu su o bir ben biz siz onlar da de ki mi ne gibi gore kadar sonra once gunu tarihli sayili
    ilgili ilgilinin basvuru basvuran sahibi sahibinin vatandas vatandasin talep istem yanit cevap arz ederim rica ederiz saygilarimla saygi geregini bilgilerinizi odemenin ekte yapilan evrak evraki ariza muhasebe denetim
    her hem daha cok en az var yok ise iken diye adlari adi soyadi ikametgahi tanik ikamet eden oturan mukim dogumlu""".split()
)
#: Folded forms of address that may stand between a given name and a surname.
ADDRESS = frozenset("abla abi agabey bey hanim hoca usta teyze amca dayi hala".split())
#: Folded stems that begin no surname, and letters that scans exchange.
_LONG = ("cadde", "bulvar", "mahalle", "ilkokul", "ortaokul", "kutuphane", "hastane", "universite", "merkez", "kultur")
_MISREAD = (("ii", "u"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("lc", "k"), ("l", "i"))
_SUFFIX = re.compile(r"(?:nin|nun|in|un|im|um|ne|na|nda|nde|ndan|nden|daki|deki|ndaki|ndeki|si|su|i|u|a|e|da|de|dan|den|lari|leri|larin|lerin)$")


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


_FOLDED = frozenset(fold(n) for n in GIVEN)
_PETS = frozenset(fold(n) for n in PETS)


@lru_cache(8)
def _near(words: frozenset[str]) -> dict[str, set[str]]:
    """The words of four letters or more by themselves and their deletions."""
    out: dict[str, set[str]] = {}
    for n in words:
        if len(n) >= 4:
            for d in {n} | _deletes(n):
                out.setdefault(d, set()).add(n)
    return out


_NEAR = _near(_FOLDED)


def one_slip(a: str, b: str) -> bool:
    """Whether one letter is missing, too many, wrong, or two neighbours are swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def given(word: str, more: frozenset[str] = frozenset()) -> int:
    """2 for a given name, 1 for one with a slip, 0 for other words; word is folded, more has given names beyond the lists."""
    if word in _FOLDED or word in _PETS or word in more:
        return 2
    if len(word) < 3 or word in NO_SURNAME:
        return 0
    near = set()
    for d in {word} | _deletes(word):
        near |= _NEAR.get(d, set())
        if more:
            near |= _near(more).get(d, set())
    return int(any(one_slip(word, n) and (len(n) > 4 or word[0] == n[0]) for n in near))


def thing(word: str) -> bool:
    """Whether a folded word names a kind of thing or place."""
    if word in _THINGS or word.startswith(_LONG):
        return True
    for wrong, right in _MISREAD:
        if wrong in word and word.replace(wrong, right).startswith(_LONG):
            return True
    stem = word
    for _ in range(3):
        cut = _SUFFIX.sub("", stem)
        if cut == stem or len(cut) < 3:
            return False
        stem = cut
        if stem in _THINGS:
            return True
    return False


_THINGS = frozenset(THINGS)
