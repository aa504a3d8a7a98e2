"""Words of the small corpus."""

EN = "the cat sat on the mat and then the dog ran over the hill to the old house by the river where people were waiting".split()
DE = "der hund und die katze sind über den hügel zum alten haus gelaufen wo viele menschen auf das schiff warten".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
