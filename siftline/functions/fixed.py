"""Word lists and tables that results depend on, stated as they are, in their natural order."""

from __future__ import annotations

#: Fixed values.
QUESTION_WORDS = tuple(
    """كيف|لماذا|متى|اين|أين|ماذا|من|هل|كم|ما|لمن|أي|اي|ايهما|أيهما|كيفاش|شحال|علاش|وين|منين|وقتاش|شكون|واش|شنو|شنا|كاش|وشنو|قداش|فين|kifach|kifash|chhal|ch7al|9adech|kadech|3lach|alach|win|wine|mnin|waqtach|chkoun|wach|chnou|chno|wchnou|comment|pourquoi|quand|où|ou|quoi|qui|combien|quel|quelle|quels|quelles|est-ce|how|why|when|where|what|who|which|whose|whom|is|are|does|do|can|should|will""".split("|")
)

#: Fixed values.
QUESTION_PHRASES = tuple(
    """ما هو|ما هي|من هو|من هي|ما معنى|كم من|هل يمكن|qu'est-ce|est-ce que|c'est quoi|how do|how to|how much|how many|what is|what are|kifach n|chhal men""".split("|")
)

#: Fixed values.
LEADING_ONLY = tuple(
    """من|ما|اي|أي|ou|qui|quoi|is|are|does|do|can|should|will|which|what|who|win|wine""".split("|")
)

#: Fixed values.
NEWS_MARKERS = tuple(
    """اليوم|الان|الآن|عاجل|أمس|امس|مباشر|جديد|آخر|اخر|لحظة|aujourd|maintenant|urgent|hier|direct|dernier|derniere|actualite|today|now|breaking|latest|live""".split("|")
)

#: Fixed values.
EVERGREEN_MARKERS = tuple(
    """كيفاش|كيف|طريقة|شروط|وثائق|كيفية|دليل|شرح|ما هو|تعريف|kifach|comment|procedure|conditions|documents|guide|demarche|how|what is|guide|steps|requirements""".split("|")
)

#: Fixed values.
NEGATORS = tuple(
    """ماشي|مانيش|ليس|لست|لا|لم|لن|بدون|غير|machi|manich|manish|makach|bla|pas|non|jamais|aucun|aucune|sans|ni|not|no|never|without|cannot|cant""".split("|")
)

#: Fixed values.
INTENSIFIERS = tuple(
    """بزاف|جدا|كثيرا|للغاية|جدًا|قاع|ياسر|bezaf|bzaf|bezzaf|ga3|tres|vraiment|extremement|absolument|totalement|very|really|extremely|absolutely|so""".split("|")
)

#: Fixed values.
DIMINISHERS = tuple(
    """شوية|قليلا|نوعا|chwiya|chwia|peu|assez|plutot|legerement|slightly|somewhat|a bit|kind of""".split("|")
)

#: Topic labels and their keywords.
TOPICS = {
    "politics": "الحكومة الوزير البرلمان الرئيس المجلس الانتخابات قانون سياسة gouvernement ministre parlement president election politique loi".split(),
    "economy": "اقتصاد استثمار التجارة الصادرات الأسعار الدينار ميزانية مؤسسة economie investissement exportations budget dinar entreprise inflation marche".split(),
    "sport": "مباراة الفريق البطولة كرة المنتخب لاعب المدرب الدوري match equipe championnat football joueur entraineur selection".split(),
    "culture": "ثقافة فيلم مهرجان الفنان كتاب معرض مسرح موسيقى culture film festival artiste livre exposition theatre musique".split(),
    "health": "الصحة المستشفى الطبيب المرض لقاح علاج وباء الأدوية sante hopital medecin maladie vaccin traitement epidemie".split(),
    "education": "التعليم المدرسة الجامعة التلاميذ الطلبة البكالوريا الأستاذ الامتحان education ecole universite eleves etudiants baccalaureat examen".split(),
    "technology": "التكنولوجيا الإنترنت الرقمنة تطبيق هاتف الشبكة المعلوماتية technologie internet numerique application reseau informatique".split(),
    "society": "المجتمع السكان الشباب الأسرة الحادث الأمن الهجرة البيئة societe population jeunesse famille accident securite environnement".split(),
}

#: Region codes from 1 on with their Arabic and French names.
REGIONS = tuple(
    (code, *names.split("/"))
    for code, names in enumerate(
        """
أدرار/Adrar
الشلف/Chlef
الأغواط/Laghouat
أم البواقي/Oum El Bouaghi
باتنة/Batna
بجاية/Béjaïa
بسكرة/Biskra
بشار/Béchar
البليدة/Blida
البويرة/Bouira
تمنراست/Tamanrasset
تبسة/Tébessa
تلمسان/Tlemcen
تيارت/Tiaret
تيزي وزو/Tizi Ouzou
الجزائر/Alger
الجلفة/Djelfa
جيجل/Jijel
سطيف/Sétif
سعيدة/Saïda
سكيكدة/Skikda
سيدي بلعباس/Sidi Bel Abbès
عنابة/Annaba
قالمة/Guelma
قسنطينة/Constantine
المدية/Médéa
مستغانم/Mostaganem
المسيلة/M'Sila
معسكر/Mascara
ورقلة/Ouargla
وهران/Oran
البيض/El Bayadh
إليزي/Illizi
برج بوعريريج/Bordj Bou Arréridj
بومرداس/Boumerdès
الطارف/El Tarf
تندوف/Tindouf
تيسمسيلت/Tissemsilt
الوادي/El Oued
خنشلة/Khenchela
سوق أهراس/Souk Ahras
تيبازة/Tipaza
ميلة/Mila
عين الدفلى/Aïn Defla
النعامة/Naâma
عين تموشنت/Aïn Témouchent
غرداية/Ghardaïa
غليزان/Relizane
تيميمون/Timimoun
برج باجي مختار/Bordj Badji Mokhtar
أولاد جلال/Ouled Djellal
بني عباس/Béni Abbès
عين صالح/In Salah
عين قزام/In Guezzam
تقرت/Touggourt
جانت/Djanet
المغير/El M'Ghair
المنيعة/El Meniaa
""".strip().split("\n"),
        1,
    )
)

#: Month names and numbers.
ARABIC_MONTHS = (("جانفي", 1), ("يناير", 1), ("فيفري", 2), ("فبراير", 2), ("مارس", 3), ("أفريل", 4), ("افريل", 4), ("أبريل", 4), ("ابريل", 4), ("ماي", 5), ("مايو", 5), ("جوان", 6), ("يونيو", 6), ("جويلية", 7), ("يوليو", 7), ("جويليه", 7), ("أوت", 8), ("اوت", 8), ("أغسطس", 8), ("اغسطس", 8), ("سبتمبر", 9), ("أكتوبر", 10), ("اكتوبر", 10), ("نوفمبر", 11), ("ديسمبر", 12))

#: Month names and numbers.
FRENCH_MONTHS = (("janvier", 1), ("fevrier", 2), ("février", 2), ("mars", 3), ("avril", 4), ("mai", 5), ("juin", 6), ("juillet", 7), ("aout", 8), ("août", 8), ("septembre", 9), ("octobre", 10), ("novembre", 11), ("decembre", 12), ("décembre", 12))

#: Month names and numbers.
ENGLISH_MONTHS = (("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9), ("october", 10), ("november", 11), ("december", 12))
