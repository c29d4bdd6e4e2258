"""Small tables with the hard cases: nulls, empty and long texts, ties, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, word string, positions string, line string, line_no int, n string, score string"


def texts(seed: int = 1) -> list:
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdéfgßñ") for _ in range(r.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = say(50)
    base = say(120)
    near = base.split()
    out = [None, "", " \t\n", "one", "One two three four", say(5), say(3000), base, base]
    for _ in range(6):
        w = list(near)
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [say(40) + " " + passage + "\n" + say(30), passage, say(10) + "  " + passage.replace(" ", "\t", 3)]
    out += ["x " * 60, "a b " * 40, "word#%$ you are an idiot\nand you are not an idiot, he said " + say(30), "\x1c odd\x85space  here " + say(12)]
    line = "A line that stands in many places, number 7."
    out += [f"{say(12)}\n{line}\n{say(3)}", f"{line}\n{line}\nshort", f"{line.replace('7', '18')}\n{say(9)}", line.replace("7", "2995"), "x" * 5000 + "\n" + say(4)]
    out += [say(r.randint(1, 80)) for _ in range(20)]
    return out


def frame(spark, rows: list, partitions: int = 3):
    made = [(i, t, "en", "s", None if t is None else len(t), "k", "w", "p", "l", 1, "n", "s") for i, t in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(partitions)


def write(spark, tmp_path, rows: list, labels: list | None = None) -> str:
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    labels = labels if labels is not None else [(i, i % 2, int(i % 7 == 0)) for i in range(len(rows))] + [(None, None, None), (999999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)
