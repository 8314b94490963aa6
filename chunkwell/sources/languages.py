"""Language data: stopwords, affixes and dotted contractions of the supported languages.

Another resource can be loaded from a JSON file (see load): the same three parts under each language's name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Language:
    name: str
    stopwords: tuple[str, ...]
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    min_len: int = 3
    contractions: tuple[str, ...] = ()

    @property
    def script(self) -> str:
        for word in self.stopwords:
            for ch in word:
                if "\u0400" <= ch <= "\u052f":
                    return "Cyrillic"
                if "\u0600" <= ch <= "\u06ff":
                    return "Arabic"
        return "Latin"


# Fixed values from here on: word lists, affixes and contractions by language.

ARABIC_WORDS = """
و في من على لا إلى عن يا أو كان أن قد ما مع هو هي هم هن أنا أنت أنتم نحن هذا هذه ذلك تلك كل بعض أي لم لن لكن كما حتى عندما بين بعد
قبل مثل غير سوى فوق تحت أمام خلف هنا هناك متى أين كيف لماذا الذي التي الذين اللاتي اللائي به لها له لهم فيه منه
"""

DUTCH_WORDS = """
aan al alles als altijd andere ben bij daar dan dat de der deze die dit doch doen door dus echter een eens elke en er ge geen
geweest haar had heb hebben hebt heeft hem het hier hij hoe hun ik in is ja je jij jouw kan kon kunnen maar me meer men met mij
mijn moet na naar niet niets nog nu of om omdat onder ons ook op over reeds te tegen toch toen tot u uit uw van veel voor want
waren was wat we wel werd wezen wie wij wil worden wordt zal ze zelf zich zij zijn zo zonder zou
"""

ENGLISH_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can did do
does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is
it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she
should so some such t than that the their theirs them themselves then there these they this those through to too under until up
very was we were what when where which while who whom why will with you your yours yourself yourselves
"""

FRENCH_WORDS = """
à au aucuns aussi autre aux avec avoir bon car ce cela ces ceux chaque ci comme comment dans de des du elle en es est et eux faire
il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sont sur ta
te tes toi ton tu un une vos votre vous y été étée étées étés étant être
"""

GERMAN_WORDS = """
ab aber als am an auch auf aus bei bin bis bist da dadurch daher damit dann das dass dasselbe dein deine deinem deinen deiner
deines dem den denn der des dessen dich die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen einer
eines er es euer eure für hat hatte hatten hattest hattet hier hin hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer ihres im in
ist ja jede jedem jeden jeder jedes jener jenes jetzt kann kannst können könnt machen man mit muss musst mein meine meinem meinen
meiner meines mich mir nach nicht nichts noch nun nur ob oder ohne sehr sei seid sein seine seinem seinen seiner seines selbst
sich sie sind so soll sollen sollst sollt sondern sonst und uns unser unsere unserem unseren unserer unseres unter vom von vor
wann war waren warst was weg weil weiter welche welchem welchen welcher welches wenn wer werde werden werdet wieder will willst
wir wird wirst wo wollen wollt zu zum zur zwar zwischen über
"""

INDONESIAN_WORDS = """
ada adalah adanya adapun agak agaknya agar akan akankah akhir akhiri akhirnya aku akulah amat amatlah anda andalah antar antara
antaranya apa apaan apabila apakah apalagi apatah atas atau bagaimana bagaimanakah bagaimanapun bagi bagian bahkan bahwa
bahwasanya bakal bakalan balik banyak bapak baru bawah beberapa begini beginian beginikah beginilah begitu begitukah begitulah
begitupun bekerja belakang belakangan belum belumlah benar benarkah benarlah berada berakhir berakhirlah berakhirnya berapa
berapakah berapalah berapapun berarti berawal berbagai berdatangan beri berikan berikut berikutnya berjumlah berkali-kali
berkata berkehendak berkeinginan berkenaan berlainan berlalu berlangsung berlebihan bermacam bermacam-macam bermaksud bermula
bersama bersama-sama bersiap bersiap-siap bertanya bertanya-tanya berturut berturut-turut bertutur berujar berupa besar betul
betulkah biasa biasanya bila bilakah bisa bisakah boleh bolehkah bolehlah buat bukan bukankah bukanlah bukannya bulan bung cara
caranya cukup cukupkah cukuplah cuma dahulu dalam dan dapat dari daripada datang demi demikian demikianlah dengan depan di dia
diakhiri diakhirinya dialah diantara diantaranya dibuat dibuatnya didapat didatangkan digunakan diibaratkan diibaratkannya
diingat diingatkan diinginkan dijawab dijelaskan dijelaskannya dikarenakan dikatakan dikatakannya dikerjakan diketahui
diketahuinya dikira dilakukan dilalui dilihat dimaksud dimaksudkan dimaksudkannya dimaksudnya diminta dimintai dimisalkan
dimulai dimulailah dimulainya dimungkinkan dini dipastikan diperbuat diperbuatnya dipergunakan diperkirakan diperlihatkan
diperlukan diperlukannya dipersoalkan dipertanyakan dipunyai diri dirinya disampaikan disebut disebutkan disebutkannya disini
disinilah ditambahkan ditandaskan ditanya ditanyai ditanyakan ditegaskan ditujukan ditunjuk ditunjuki ditunjukkan ditunjukkannya
ditunjuknya dituturkan dituturkannya diucapkan diucapkannya diungkapkan dong dua dulu empat enggak enggaklah entah entahlah guna
gunakan hal hampir hanya hanyalah hari harus haruslah harusnya hendak hendaklah hendaknya hingga ia ialah ibarat ibaratnya ibu
ikut ingat ingat-ingat ingin inginkah inginkan ini inikah inilah itu itukah itulah jadi jadilah jadinya jangan jangankan
janganlah jauh jawab jawaban jawabnya jelas jelaslah jelasnya jika jikalau juga jumlah jumlahnya justru kala kalau kalaulah
kalaupun kalian kami kamilah kamu kamulah kan kapan kapankah kapanpun karena karenanya kasus kata katakan katakanlah katanya ke
keadaan kebetulan kecil kedua keduanya keinginan kelak kelima keluar kembali kemudian kemungkinan kemungkinannya kenapa kepada
kepadanya kesampaian keseluruhan keseluruhannya keterlaluan ketika khususnya kini kinilah kira kira-kira kiranya kita kitalah
kok lagi lagian lah lain lainnya lalu lama lamanya lanjut lanjutnya lebih lewat lima luar macam maka makanya makin malah malahan
mampu mampukah mana manakala manalagi masa masalah masalahnya masih masihkah masing masing-masing mau maupun melainkan melakukan
melalui melihat melihatnya memang memastikan memberi memberikan membuat memerlukan memihak meminta memintakan memisalkan
memperbuat mempergunakan memperkirakan memperlihatkan mempersiapkan mempersoalkan mempertanyakan mempunyai memulai memungkinkan
menaiki menjadi menjawab menjelaskan menuju menurut menuturkan menyampaikan menyangkut menyatakan menyebutkan menyeluruh
menyiapkan merasa mereka merekalah merupakan meski meskipun meyakini meyakinkan minta mirip misal misalkan misalnya mula mulai
mulailah mulanya mungkin mungkinkah nah naik namun nanti nantinya nyaris nyatanya oleh olehnya pada padahal padanya pak paling
panjang pantas para pasti pastilah penting pentinglah pentingnya per percuma perlu perlukah perlunya pernah persoalan pertama
pertama-tama pertanyaan pertanyakan pihak pihaknya pukul pula pun punya rasa rasanya rata rupanya saat saatnya saja sajalah
saling sama sama-sama sambil sampai sampai-sampai sana sangat sangatlah satu saya sayalah se sebab sebabnya sebagai sebagaimana
sebagainya sebagian sebaik sebaik-baiknya sebaiknya sebaliknya sebanyak sebelum sebelumnya sebenarnya seberapa sebesar
sebetulnya sebisanya sebuah sebut sebutlah sebutnya secara secukupnya sedang sedangkan sedemikian sedikit sedikitnya seenaknya
segala segalanya segera seharusnya sehingga seingat sejak sejauh sejenak sejumlah sekadar sekadarnya sekali sekali-kali sekalian
sekaligus sekalipun sekarang sekaranglah sekecil seketika sekiranya sekitar sekitarnya sela selain selaku selalu selama
selama-lamanya selamanya selanjutnya seluruh seluruhnya semacam semakin semampu semampunya semasa semasih semata semata-mata
semaunya sementara semisal semisalnya sempat semua semuanya semula sendiri sendirian sendirinya seolah seolah-olah seorang
sepanjang sepantasnya sepantasnyalah seperlunya seperti sepertinya sepeserpun sering seringnya serta serupa sesaat sesama
sesampai sesegera sesekali seseorang sesuatu sesuatunya sesudah sesudahnya setelah setempat setengah seterusnya setiap setiba
setibanya setidak-tidaknya setidaknya setinggi seusai sewaktu siap siapa siapakah siapapun sini sinilah suatu sudah sudahkah
sudahlah supaya tadi tadinya tahu tahun tak tambah tambahnya tampak tampaknya tandas tandasnya tanpa tanya tanyakan tanyanya
tapi tegas tegasnya telah tempat tengah tentang tentu tentulah tentunya terakhir terasa terbanyak terdahulu terdapat terdiri
terhadap terhadapnya teringat teringat-ingat terjadi terjadilah terjadinya terkira terlalu terlebih terlihat termasuk ternyata
tersampaikan tersebut tersebutlah terserah tertentu tertuju terus terutama tetap tetapi tiap tidak tidakkah tidaklah tiga toh
tunjuk turur turut tuturnya ucap ucapnya ujar ujarnya umum umumnya ungkap ungkapnya untuk usah usai waduh wah wahai waktu
waktunya walau walaupun ya yaitu yakni yang
"""

ITALIAN_WORDS = """
a ad al allo ai agli alla alle con col coi da dal dallo dai dagli dalla dalle di del dello dei degli della delle in nel nello nei
negli nella nelle su sul sullo sui sugli sulla sulle per tra fra e o ma se che non anche ancora appena come dove quando perché
perciò però più pure sempre solo allora aveva avevamo avevano avevate avevo avrà avrai avranno avrebbe avrebbero avrei avremmo
avremo avreste avresti avrete c ci cui ebbe ebbero ebbi era eravamo erano eravate ero essendo faccia facciamo facciano facciate
faccio fai fanno fare farà farai faranno fece fecero feci fosse fossero fossi fossimo foste fosti fu fui fummo furono gli ha hai
hanno ho i il io l la le lei lo loro lui mi mia mie miei mio ne noi nostra nostre nostri nostro quale quanta quante quanti quanto
quella quelle quelli quello questa queste questi questo sarà sarai saranno sia siamo siano siate sii sono sta stai stando stanno
stava stavamo stavano stavate stavi stavo stessa stesse stessi stesso stette stettero stetti stia stiamo stiano stiate sto sua sue
suo sui ti tu tua tue tuo tuoi un una uno vi voi vostra vostre vostri vostro è
"""

PORTUGUESE_WORDS = """
a à adeus agora aí ainda além algo alguém algum alguma algumas alguns ali ao aos apenas após aquela aquelas aquele aqueles aqui
aquilo as às assim até com como contra da das de dela delas dele deles depois desde dessa dessas desse desses desta destas deste
destes do dos e é ela elas ele eles em enquanto entre era eram essa essas esse esses esta está estamos estão estar estas estava
estavam este estes estou eu foi fomos for fora foram fui há isso isto já lhe lhes logo mais mas me mesma mesmas mesmo mesmos meu
meus minha minhas muita muitas muito muitos na não nas nem nenhum nessa nessas nesta nestas ninguém no nos nós nossa nossas nosso
nossos num numa nunca o os ou outra outras outro outros para pela pelas pelo pelos por porém porque posso pouco pude qual quando
quanto que quem quer se seja sejam sem sempre sendo será serão seu seus só sob sobre sua suas talvez também tão te tem têm tendo
tenha ter teu teus teve ti tido tinha tinham toda todas todo todos tu tua tuas tudo um uma você vocês vos
"""

RUSSIAN_WORDS = """
а это без более больше будет будто бы был была были было быть в вам вас вдруг ведь во вот впрочем все всегда всего всех всю вы где
да даже два для до другой его ее ей ему если есть еще ж же за зачем здесь и из или им иногда их к кажется как какая какой когда
конечно которого которые кто куда ли либо лучше между меня мне много может можно мой моя мы на над надо наконец нас не него нее
нет ни нибудь никогда ним них ничего но ну о об один он она они оно опять от перед по под после потом потому почти при про раз
разве с сам свое свою себе себя сейчас со совсем так также такой там те тебя тем теперь то тогда того тоже той только том тот три
тут ты у уж уже хорошо хоть чего чем через что чтоб чтобы чуть эти этого этой этом этот эту я
"""

SPANISH_WORDS = """
de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este ha sí porque esta son entre está
cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e
esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas
algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos
suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras esos esas estoy estás estamos estáis están esté estés
estemos estéis estén estaré estarás estará estaremos estaréis estarán estaría estarías estaríamos estaríais estarían estaba
estabas estábamos estabais estaban estuve estuviste estuvo estuvimos estuvisteis estuvieron estuviera estuvieras estuviéramos
estuvierais estuvieran estuviese estuvieses estuviésemos estuvieseis estuviesen estando estado estada estados estadas he has hemos
habéis han haya hayas hayamos hayáis hayan habré habrás habrá habremos habréis habrán habría habrías habríamos habríais habrían
había habías habíamos habíais habían hube hubiste hubo hubimos hubisteis hubieron hubiera hubieras hubiéramos hubierais hubieran
hubiese hubieses hubiésemos hubieseis hubiesen habiendo habido habida habidos habidas soy eres es somos sois son sea seas seamos
seáis sean seré serás será seremos seréis serán sería serías seríamos seríais serían era eras éramos erais eran fui fuiste fue
fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran fuese fueses fuésemos fueseis fuesen tengo tienes tiene tenemos tenéis
tienen tenga tengas tengamos tengáis tengan tendré tendrás tendrá tendremos tendréis tendrán tendría tendrías tendríamos tendríais
tendrían tenía tenías teníamos teníais tenían tuve tuviste tuvo tuvimos tuvisteis tuvieron tuviera tuvieras tuviéramos tuvierais
tuvieran tuviese tuvieses tuviésemos tuvieseis tuviesen teniendo tenido tenida tenidos tenidas
"""

VIETNAMESE_WORDS = """
là đi đâu của và các có được cho không một những này đó khi thì mà ở tại bị bởi cũng đã để đến do hơn hay lại làm như nhiều nếu
nào ra rằng rất rồi sau sẽ theo phải vào vẫn về vì với ấy anh em chị chú bác cô gì tôi ta nó họ mình ai đây kia
"""

LANGUAGES = {
    x.name: x
    for x in (
        Language("arabic", tuple(ARABIC_WORDS.split()), ("ال", "وال", "فال", "بال", "كال", "لل", "و", "ف", "ب", "ك", "ل", "س",), ("يات", "يون", "يين", "كما", "هما", "وات", "ات", "ون", "ين", "هم", "هن", "ها", "كم", "نا", "ة", "ي", "ه",), 2, ()),
        Language("dutch", tuple(DUTCH_WORDS.split()), ("ge",), ("tjes", "etje", "tje", "jes", "eren", "heid", "heden", "ing", "ingen", "lijk", "en", "e", "s",), 3, ("bv.", "dwz.", "enz.", "as.", "o.a.",)),
        Language("english", tuple(ENGLISH_WORDS.split()), (), ("ingly", "edly", "ization", "ational", "fulness", "ousness", "iveness", "ments", "ement", "ations", "ation", "ing", "ed", "alization", "ly", "es", "s",), 3, ("e.g.", "i.e.", "etc.",)),
        Language("french", tuple(FRENCH_WORDS.split()), (), ("issements", "issement", "ements", "ement", "atrice", "ateurs", "ateur", "euses", "euse", "tion", "ions", "ment", "s", "es",), 3, ("etc.", "M.",)),
        Language("german", tuple(GERMAN_WORDS.split()), ("ge",), ("chen", "lein", "erweise", "lich", "keit", "keiten", "ungen", "ung", "isch", "en", "er", "e", "n", "s",), 3, ("z.B.", "usw.", "d.h.", "bzw.", "u.a.", "etc.",)),
        Language("indonesian", tuple(INDONESIAN_WORDS.split()), ("meng", "meny", "men", "mem", "me", "peng", "peny", "pen", "pem", "pe", "ber", "ter", "per", "di", "ke", "se",), ("kan", "i", "an",), 3, ()),
        Language("italian", tuple(ITALIAN_WORDS.split()), (), ("mente", "azioni", "azione", "atori", "atore", "atrice", "atrici", "issimi", "issimo", "amente", "ità", "i", "e", "o", "a", "s",), 3, ("ecc.", "es.",)),
        Language("portuguese", tuple(PORTUGUESE_WORDS.split()), (), ("mente", "ções", "ção", "amentos", "amento", "idades", "idade", "eza", "ezas", "ões", "os", "as", "es", "s",), 3, ()),
        Language("russian", tuple(RUSSIAN_WORDS.split()), (), ("иями", "ями", "ами", "ость", "остей", "остям", "иях", "его", "ого", "ему", "ому", "ыми", "ими", "ее", "ое", "ая", "яя", "ий", "ый", "ой", "ей", "ам", "ям", "ах", "ях", "ом", "ем", "ою", "ею", "ую", "юю", "ов", "ев", "ей", "ы", "и", "а", "я", "о", "е", "у", "ю", "ь",), 2, ("т.е.", "т.к.", "и т.д.", "и т.п.",)),
        Language("spanish", tuple(SPANISH_WORDS.split()), (), ("mente", "aciones", "ación", "adoras", "adora", "adores", "ador", "amiento", "amientos", "ancias", "ancia", "es", "s",), 3, ()),
        Language("vietnamese", tuple(VIETNAMESE_WORDS.split()), (), (), 1, ()),
    )
}


def load(path: str) -> dict[str, Language]:
    """A resource file: {language: {stopwords, stemming: {prefixes, suffixes, min_len}, contractions}}."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    out = {}
    for name, data in sorted(raw.items()):
        affixes = data.get("stemming") or {}
        if data.get("stopwords"):
            out[name] = Language(name, tuple(data["stopwords"]), tuple(affixes.get("prefixes", ())), tuple(affixes.get("suffixes", ())), int(affixes.get("min_len", 0)), tuple(data.get("contractions") or ()))
    return out
