from datetime import datetime, timezone

COMMITS = "repo_id string, seq int, hash string, author_name string, author_email string, author_date timestamp, parents array<string>, subject string, body string, files array<struct<path:string,added:int,deleted:int,old_path:string>>, ingested_at timestamp"


def day(n, hour=0, minute=0):
    return datetime(2026, 1, n, hour, minute, tzinfo=timezone.utc)


def commit(seq, hash_, date, subject, files, body="", email="alice@test.com", repo="r", parents=("p",)):
    rows = [(f, None, None, None) if isinstance(f, str) else (*f, *[None] * (4 - len(f))) for f in files]
    return (repo, seq, hash_, email.split("@")[0].title(), email, date, list(parents), subject, body, rows, date)


def sample(spark):
    bob = "bob@test.com"
    return spark.createDataFrame(
        [
            commit(0, "aaa1111", day(1), "feat(auth): add login endpoint", [("src/auth/login.ts", 100, 0), ("src/auth/session.ts", 50, 0), ("tests/auth/test_login.ts", 30, 0)]),
            commit(1, "bbb2222", day(1, 1), "fix(auth): handle null token", [("src/auth/login.ts", 5, 2), ("src/auth/session.ts", 3, 1)]),
            commit(2, "ccc3333", day(2), "feat(api): add user profile endpoint", [("src/api/profile.ts", 80, 0), ("src/models/user.ts", 20, 5)], email=bob),
            commit(3, "ddd4444", day(3), 'Revert "feat(auth): add login endpoint"', [("src/auth/login.ts", 0, 100), ("src/auth/session.ts", 0, 50)], "This reverts commit aaa1111."),
            commit(4, "eee5555", day(4), "chore: update dependencies", [("package.json", 5, 5), ("package-lock.json", 500, 500)], email=bob),
        ],
        COMMITS,
    )
