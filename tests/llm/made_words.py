import random


def words(n, seed, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(2, 6))) for _ in range(n)]
