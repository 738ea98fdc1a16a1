"""A small corpus of verses and names, for trying the vocabulary job without pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import CORPUS

# Chapter, verse, number of words and text of the sample documents.
# fmt: off
SAMPLES = [
    (1, "1", 12,
     "Dhṛtarāṣṭra Sañjaya Pāṇḍu Kurukṣetra dharma-kṣetre kuru-kṣetre samavetā yuyutsavaḥ māmakāḥ pāṇḍavāś caiva kim akurvata"),
    (2, "1", 10,
     "Sañjaya Arjuna kṛpayā paripūrṇa aśru-pūrṇa īkṣaṇa viṣīdantam idaṁ vākyam uvāca Madhusūdana"),
    (2, "47", 15,
     "karmaṇy evādhikāras te mā phaleṣu kadācana mā karma-phala-hetur bhūr mā te saṅgo 'stv akarmaṇi karma yoga dharma"),
    (4, "7", 13,
     "yadā yadā hi dharmasya glānir bhavati bhārata abhyutthānam adharmasya tadātmānaṁ sṛjāmy aham avatāra dharma adharma"),
    (7, "1", 16,
     "Śrī Bhagavān uvāca mayy āsakta-manāḥ pārtha yogaṁ yuñjan mad-āśrayaḥ asaṁśayaṁ samagraṁ māṁ yathā jñāsyasi tac chṛṇu yoga bhakti jñāna"),
    (9, "22", 13,
     "ananyāś cintayanto māṁ ye janāḥ paryupāsate teṣāṁ nityābhiyuktānāṁ yoga-kṣemaṁ vahāmy aham bhakti yoga kṣema"),
    (15, "7", 14,
     "mamaivāṁśo jīva-loke jīva-bhūtaḥ sanātanaḥ manaḥ-ṣaṣṭhānīndriyāṇi prakṛti-sthāni karṣati jīva ātman prakṛti indriya manas"),
    (18, "65", 14,
     "man-manā bhava mad-bhakto mad-yājī māṁ namaskuru mām evaiṣyasi satyaṁ te pratijāne priyo 'si me bhakti namaskāra priya satya"),
    (18, "66", 15,
     "sarva-dharmān parityajya mām ekaṁ śaraṇaṁ vraja ahaṁ tvāṁ sarva-pāpebhyo mokṣayiṣyāmi mā śucaḥ śaraṇāgati mokṣa dharma pāpa"),
    (None, "general", 45,
     "Kṛṣṇa Rādhā Govinda Gopāla Vāsudeva Viṣṇu Nārāyaṇa Śiva Brahmā Gaṅgā Yamunā Vṛndāvana Mathurā Dvārakā Jagannātha Baladeva Subhadrā Caitanya Nityānanda Advaita Gadādhara Śrīvāsa guru paramparā sādhu saṅga kīrtana bhajana ārati maṅgala-ārati prasādam mahā-prasādam ekādaśī parikramā darśana sevā pūjā abhiṣeka śṛṅgāra bhoga rāga-mārga vaidhi-bhakti rāgānugā-bhakti prema bhāva rati āsakti bhāva-bhakti prema-bhakti"),
]
# fmt: on


def sample_corpus(spark: SparkSession) -> DataFrame:
    """The sample documents as corpus rows in order (``seq``); the last one, of names in general, has no chapter."""
    rows = []
    for seq, (chapter, verse, words, text) in enumerate(SAMPLES):
        place = f"bg/{chapter}/{verse}" if chapter else "general/sanskrit"
        title = f"Bhagavad Gita {chapter}.{verse} Sanskrit Terms" if chapter else "Common ISKCON Sanskrit Terms"
        rows.append((f"sample://{place}", title, text, chapter, verse, "sample_sanskrit", 1640995200.0, words, seq))
    return spark.createDataFrame(rows, CORPUS + ", seq long").orderBy(F.col("seq"))
