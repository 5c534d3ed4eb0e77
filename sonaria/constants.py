"""Fixed values that define results. They are settings of the data model, not tuning knobs."""

# Audio.
SAMPLE_RATE = 16000
TTS_SAMPLE_RATE = 24000
TARGET_DBFS = -18.0
MIN_MODEL_SEC = 0.9
MIN_ENROL_SEC = 3.0
MIN_VERIFY_SEC = 0.3
PCM16_MAX = 32767
PCM16_BUFFER_MAX = 32768
CHUNK_SAMPLES = 320
AUDIO_SUFFIXES = (".wav", ".mp3", ".flac", ".m4a", ".ogg")

# Speaker matching.
MATCH_THRESHOLD = 0.65
TOP_K = 5
MAX_TOP_K = 50
NORM_EPS = 1e-12
SILENT_ATOL = 1e-7
SPEAKER_DIM = 192

# Streaming sessions.
ASR_WINDOW_SEC = 8.0
ASR_EMIT_SEC = 2.0
VERIFY_WINDOW_SEC = 8.0
VERIFY_INACTIVITY_SEC = 120.0
VERIFY_EMIT_MS = 500
MESSAGE_VERSION = 1

# Reference-voice clean-up, milliseconds and dBFS.
SILENCE_STEP_MS = 10
LONG_SILENCE = (1000, -50.0)
SHORT_SILENCE = (100, -40.0)
KEEP_SILENCE_MS = 1000
VOICE_SOFT_MS = 6000
VOICE_CAP_MS = 12000
EDGE_DBFS = -42.0
TAIL_SILENCE_MS = 50

# Corpus preparation.
BATCH_ROWS = 64
WAV_NAME_FORMAT = "cv_%07d.wav"
DEFAULT_VOICE = "_default"
FORMAT_MIME = {"wav": "audio/wav", "mp3": "audio/mpeg", "ogg": "audio/ogg"}
CHARS_PER_SECOND = 13.0

# Token labels. A label is <case>_<mark>; the dash mark is the one whose
# suffix depends on the case part.
LABEL_CASES = ("LOWER", "UPPER", "UPPER_TOTAL")
LABEL_MARKS = {
    "O": "",
    "PERIOD": ".",
    "COMMA": ",",
    "QUESTION": "?",
    "TIRE": "—",
    "DVOETOCHIE": ":",
    "VOSKL": "!",
    "PERIODCOMMA": ";",
    "DEFIS": "-",
    "MNOGOTOCHIE": "...",
    "QUESTIONVOSKL": "?!",
}
SPACED_DASH = " —"
