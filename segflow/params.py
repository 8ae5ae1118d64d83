"""Defaults of the engine; every operator takes them as arguments."""

# Thresholds in seconds, characters and counts.
MIN_SEGMENT_SEC = 0.35
MERGE_MAX_SEC, MERGE_MAX_CHARS, MERGE_GAP_SEC, MERGE_VERY_SHORT_SEC = 12.0, 320, 0.85, 0.70
CHUNK_MAX_SEC, CHUNK_MAX_CHARS, CHUNK_GAP_SEC = 18.0, 1100, 1.0
UNIT_MAX_SENTENCES, UNIT_MAX_CHARS, UNIT_GAP_SEC = 2, 300, 1.20
MIN_WEIGHT = 1
OUTPUT_REPEATS, INPUT_REPEATS = 3, 4
LONG_TEXT_CHARS = 2000
MIN_PART_SEC, EPSILON, MIN_SPEECH_SEC = 0.15, 1e-6, 0.001
MIN_TRIM_SEC, MIN_SPEED = 0.05, 1e-6
DURATION_SCALE, MIN_TARGET_SEC, DURATION_TOLERANCE, QUALITY_RETRIES = 1.15, 0.5, 0.5, 1
REF_MIN_SEC, REF_MAX_SEC, REF_TARGET_SEC, REF_FALLBACK_SEC, REF_SEGMENT_SEC = 3.0, 15.0, 8.0, 1.0, 0.3
TRANSLATE_RETRIES, TRANSLATE_BACKOFF_SEC = 3, 1.5
CHUNK_REFERENCE_GB, CHUNK_REFERENCE_SEC, CHUNK_SAFETY, CHUNK_MIN_SEC, CHUNK_LIMIT_SEC = 14.0, 600, 0.80, 120, 1800
HOP_SAMPLES, SAMPLE_RATE = 3200, 24000
MEDIA_SUFFIXES = (".mp4", ".mkv", ".mov", ".webm", ".m4v")
OUTPUT_SUFFIX = "_xlDub.mp4"
ASR_ENGINES, AUDIO_MODES, TTS_ENGINES = ("vibevoice", "whisper"), ("true", "false"), ("omnivoice", "voxcpm2", "irodori")

# Texts that stand for a failed or skipped translation.
ERROR_MARK, REPETITIVE_INPUT_MARK, REPETITIVE_PART_MARK = "翻訳エラー", "（繰り返し音声）", "繰り返し音声エラー"
