SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "mi", "tes", "lor", "un", "vé"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
