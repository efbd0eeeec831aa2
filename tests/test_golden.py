"""Retrieval on a small made-up repository: fourteen questions with the files that answer them, all arms, all measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import chunking, embedding, evaluation, retrieval
from corpusmill.operators import text as X
from corpusmill.plans.search_queries import STOP

FILES = {
    "src/login/passwords.ts": "import { randomBytes, scryptSync, timingSafeEqual } from 'crypto';\n\n// Passwords are salted and hashed with scrypt before they are stored.\nexport function hashPassword(plain: string): string {\n  const salt = randomBytes(16).toString('hex');\n  return salt + ':' + scryptSync(plain, salt, 32).toString('hex');\n}\n\n// Compares in constant time, so that timing tells nothing about the stored hash.\nexport function passwordMatches(plain: string, stored: string): boolean {\n  const [salt, digest] = stored.split(':');\n  return timingSafeEqual(Buffer.from(digest, 'hex'), scryptSync(plain, salt, 32));\n}\n",
    "src/login/tickets.ts": "import { createHmac } from 'crypto';\n\n// A signed session ticket that runs out after some minutes.\nexport function issueTicket(userId: string, secret: string, minutes = 30): string {\n  const body = JSON.stringify({ userId, until: Date.now() + minutes * 60000 });\n  const mark = createHmac('sha256', secret).update(body).digest('base64url');\n  return Buffer.from(body).toString('base64url') + '.' + mark;\n}\n\n// Refuses tickets whose signature is wrong or that have expired.\nexport function readTicket(ticket: string, secret: string): { userId: string } | null {\n  const [body, mark] = ticket.split('.');\n  const text = Buffer.from(body, 'base64url').toString();\n  if (createHmac('sha256', secret).update(text).digest('base64url') !== mark) return null;\n  const seen = JSON.parse(text);\n  return seen.until > Date.now() ? seen : null;\n}\n",
    "src/shop/checkout.ts": "import { chargeCard } from './cards';\nimport { OrderBook } from './orders';\n\n// Takes the money for a basket and writes the order down; a failed charge leaves the order unpaid.\nexport async function checkout(basket: Basket, book: OrderBook): Promise<Order> {\n  const order = book.open(basket);\n  const receipt = await chargeCard(order.total, basket.cardToken);\n  return receipt.ok ? book.markPaid(order.id, receipt.id) : order;\n}\n",
    "src/shop/cards.ts": "// Talks to the payment provider; retries when the network drops.\nexport async function chargeCard(cents: number, cardToken: string, tries = 3): Promise<Receipt> {\n  for (let k = 0; k < tries; k++) {\n    const reply = await fetch('https://pay.invalid/charges', { method: 'POST', body: JSON.stringify({ cents, cardToken }) });\n    if (reply.ok) return reply.json();\n  }\n  return { ok: false, id: '' };\n}\n\n// Gives money back, in part or in full.\nexport async function refundCharge(receiptId: string, cents: number): Promise<void> {\n  await fetch('https://pay.invalid/refunds', { method: 'POST', body: JSON.stringify({ receiptId, cents }) });\n}\n",
    "src/shop/orders.ts": "export class OrderBook {\n  private rows = new Map<string, Order>();\n\n  // Opens an unpaid order with the sum of all lines of the basket.\n  open(basket: Basket): Order {\n    const total = basket.lines.reduce((sum, l) => sum + l.cents * l.count, 0);\n    const order = { id: String(this.rows.size + 1), total, paid: false };\n    this.rows.set(order.id, order);\n    return order;\n  }\n\n  markPaid(id: string, receiptId: string): Order {\n    const order = { ...this.rows.get(id)!, paid: true, receiptId };\n    this.rows.set(id, order);\n    return order;\n  }\n}\n",
    "src/store/pool.ts": "import { Client } from 'pg';\n\n// Keeps a few open database connections and hands them out in turn.\nexport class ConnectionPool {\n  private idle: Client[] = [];\n\n  async borrow(): Promise<Client> {\n    return this.idle.pop() ?? new Client({ connectionString: process.env.DATABASE_URL });\n  }\n\n  giveBack(client: Client): void {\n    this.idle.push(client);\n  }\n}\n",
    "src/store/migrate.ts": "// Runs schema migrations that have not been applied yet, in the order of their numbers.\nexport async function applyMigrations(client: Client, steps: Migration[]): Promise<number> {\n  const done = await client.query('select max(number) from migrations');\n  const open = steps.filter((s) => s.number > done);\n  for (const s of open) await client.query(s.sql);\n  return open.length;\n}\n",
    "src/web/throttle.ts": "// Counts requests of every visitor in a fixed window and turns away those beyond the limit.\nexport class Throttle {\n  private seen = new Map<string, { count: number; until: number }>();\n\n  allows(visitor: string, limit: number, windowMs: number): boolean {\n    const now = Date.now();\n    const row = this.seen.get(visitor);\n    if (!row || row.until < now) {\n      this.seen.set(visitor, { count: 1, until: now + windowMs });\n      return true;\n    }\n    row.count += 1;\n    return row.count <= limit;\n  }\n}\n",
    "docs/running.md": "# Running the shop\nHow to start it on your machine.\n\n## Environment variables\nSet DATABASE_URL for the store and TICKET_SECRET for session tickets before the first start.\n\n## Deploying\nBuild the image, push it to the registry and restart the service; migrations run at the start.\n",
}
CASES = [
    ("how are passwords stored safely", ["src/login/passwords.ts"], "semantic"),
    ("what stops someone from guessing the hash by timing", ["src/login/passwords.ts"], "semantic"),
    ("when does a user's session run out", ["src/login/tickets.ts"], "semantic"),
    ("what happens when a payment fails during checkout", ["src/shop/checkout.ts", "src/shop/cards.ts"], "semantic"),
    ("how does a customer get money back", ["src/shop/cards.ts"], "semantic"),
    ("how is the total of an order worked out", ["src/shop/orders.ts"], "semantic"),
    ("how are too many requests turned away", ["src/web/throttle.ts"], "semantic"),
    ("applyMigrations", ["src/store/migrate.ts"], "lexical"),
    ("ConnectionPool borrow", ["src/store/pool.ts"], "lexical"),
    ("where is chargeCard defined and retried", ["src/shop/cards.ts"], "both"),
    ("which environment variables are needed to start", ["docs/running.md"], "both"),
    ("how does readTicket check the signature", ["src/login/tickets.ts"], "both"),
    ("how are database connections handed out", ["src/store/pool.ts"], "both"),
    ("where is an order marked as paid, markPaid", ["src/shop/orders.ts"], "both"),
]


def averages(spark):
    files = spark.createDataFrame([("shop", p, c) for p, c in FILES.items()], "repo_id string, path string, content string")
    chunks = X.context(chunking.chunk_corpus(files)).withColumn("chunk_id", F.xxhash64("content_hash"))
    chunks = chunks.withColumn("body", X.embed_text()).cache()
    questions = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(CASES)], "query_id long, question string")
    qrels = spark.createDataFrame([(i, p) for i, (_, paths, _) in enumerate(CASES) for p in paths], "case_id long, path string")
    vectors = embedding.hash_embed(chunks, "chunk_id", "body", 1536)
    asked = embedding.hash_embed(questions.withColumnRenamed("question", "text"), "query_id", "text", 1536)
    dense = retrieval.dense_topk(asked, vectors).cache()
    index = retrieval.postings(chunks.withColumn("all", F.concat_ws(" ", "path", F.coalesce("symbol", F.lit("")), "content")), "all", list(STOP))
    lexical = retrieval.lexical_topk(retrieval.question_terms(questions, list(STOP)), index).cache()
    fused = retrieval.top(retrieval.rrf_fuse(dense, lexical), "rrf", 12)
    runs = None
    for name, run in (("dense", dense.where("rank <= 10")), ("lexical", lexical.where("rank <= 10")), ("hybrid", fused)):
        named = run.join(chunks.select("chunk_id", "path"), "chunk_id").select(F.lit(name).alias("config"), F.col("query_id").alias("case_id"), "path", "rank")
        runs = named if runs is None else runs.unionByName(named)
    measures = evaluation.case_measures(evaluation.dedupe_by_path(runs), qrels, questions.select(F.col("query_id").alias("case_id")))
    return {r.config: r.asDict() for r in evaluation.macro_average(measures).collect()}, evaluation.quality_gate(evaluation.macro_average(measures))


def test_hybrid_is_no_worse_than_its_arms(spark):
    got, gate = averages(spark)
    for name, row in got.items():
        print(name, {k: round(v, 4) for k, v in row.items() if k != "config"})
    assert got["hybrid"]["mrr"] >= max(got["dense"]["mrr"], got["lexical"]["mrr"])
    assert {r.config: r.passed for r in gate.collect()}["hybrid"]
    assert got["hybrid"]["hit_5"] == 1.0
