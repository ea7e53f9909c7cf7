r"""Tables of the Japanese style rules.

Fixed values throughout: words and patterns define what the rules are, so they are stated as they are known, in their
natural order.  Patterns are Java regular expressions; units are lines or sentences of visible text without emphasis
marks, with quoted mentions replaced by a middle dot.
"""

from __future__ import annotations

# ---- fixed values: words ---------------------------------------------------------------------------------------
SLOP_WORDS = [
    "手触り", "肌感", "肌感覚", "体温", "温度感", "熱量", "血の通った", "泥臭い", "泥臭さ",
    "解像度", "腹落ち", "メンタルモデル", "本質的", "地に足のついた", "等身大",
    "営み", "装置", "土台", "羅針盤", "起爆剤", "触媒",
    "真理", "虚飾", "境地", "美学", "深淵", "冷徹", "禁欲的", "優美", "極致", "宿命", "正本",
]
SLOP_SHAPES = [
    ("ゲート", r"(?:(?<![ァ-ヴー])|(?<=レビュー)|(?<=リリース)|(?<=チェック)|(?<=デプロイ)|(?<=マージ)|(?<=テスト))(?<!搭乗)(?<!改札)(?<!品質)ゲート(?!ウ[ェエ]イ|ボール|キーパー)"),
    ("閉包", r"(?<!推移)(?<!反射)(?<!対称)(?<!凸)(?<!代数)(?<!代数的)閉包(?!演算)"),
    ("台帳", r"(?<!資産)(?<!住民基本)(?<!会計)(?<!会計の)(?<!行政の)(?<!課税)(?<!土地)(?<!家屋)(?<!備品)(?<!登記)台帳"),
    ("〜のOS", r"(思考|意思決定|仕事|人生|組織|チーム|学習|経営)の?OS(?![A-Za-z])"),
    ("本質を突く", r"本質を突"),
]
METAPHOR_VERBS = [
    ("比喩動詞「効く」の過剰使用", r"(地味に|よく|じわじわ)効[かきくけいた]"),
    ("比喩動詞「壊れる」", r"(データ|仕様|設計|環境|ビルド|システム|秩序)が(静かに)?壊れ"),
    ("英語直訳「静かに壊れる (silently fail)」", r"静かに(壊れ|落ち|失敗|沈黙)"),
    ("英語直訳「黙って無視される」", r"黙って(無視|捨て|スキップ|破棄)"),
    ("判断を方向で表現する「〜側に倒す」", r"側に倒[すしせ]"),
    ("比喩動詞「時間を溶かす」", r"時間[をに]溶か[したす]"),
    ("比喩動詞「潰す」", r"(1つずつ|一つずつ)潰[していくす]"),
    ("比喩動詞「踏み込む」", r"(実装|詳細|コード|設計|内部|仕組み|領域|本質)(に|まで|へ)踏み込[んむみま]"),
    ("比喩動詞「引き返す」", r"動かしながら引き返[すし]"),
    ("比喩動詞「添える」", r"代わりに添え[るた]"),
    ("比喩動詞「収斂する」", r"(議論|意見|結論|方向性|価格|話題|検討)が[^。！？!?]*?収斂"),
    ("英語直訳「〜した瞬間 (the moment ...)」", r"した瞬間に?"),
    ("抽象比喩「前提が崩れる」", r"(前提|基盤)が崩れ[るた]"),
    ("非生物主語「文化が醸成される」", r"文化が醸成"),
    ("非生物主語「プロセスが定着する」", r"プロセスが定着"),
    ("非生物主語「事例が残した」", r"事例が残した"),
]
FILLERS = [
    ("前置フィラー「重要なのは」", r"^(まず|ここで)?(重要|大切|大事)なのは、?"),
    ("前置フィラー「結論から言うと」", r"^結論から(言|い)(う|い|え)|^結論から申し上げ"),
    ("前置フィラー「正直に言うと」", r"^正直に言うと、?"),
    ("前置フィラー「本音を言うと」", r"^本音を言うと、?"),
    ("前置フィラー「避けたいのは」", r"^避けたいのは、?"),
    ("前置フィラー「ポイントは、」", r"^ポイントは、"),
    ("自己ラベル「見落とされがち」など", r"見落とされがち|面白いのはここ|まさにそこがポイント"),
    ("定型クロージング「いかがでしたでしょうか」", r"いかがでした(でしょうか|か)?[？?。]?\z"),
    ("定型クロージング「ぜひ〜してみてください」", r"ぜひ(参考|試し|活用)(に)?して(みて)?ください[！!。]?"),
    ("定型クロージング「参考になれば幸いです」など", r"参考に(なれ|な)ば幸い|お役に立て(れ)?ば幸い|ぜひご(活用|参考に)ください|まずは小さく(始め|はじめ)(?:ましょう|てみましょう|てください|てみてください|てみませんか|て(?:みて)?はいかが(?:ですか|でしょうか)|る(?:ことが(?:大切|大事|重要)|のがおすすめ)です)[。！？!?]?\z"),
    ("過剰な自己ラベリング「〜に他なりません」", r"に他なりません"),
    ("チャット応答の名残「ご質問ありがとうございます」", r"^ご質問ありがとうございます"),
    ("定型導入「それでは見ていきましょう」など", r"見ていきましょう[。！!]?\z|深掘りしていきます"),
    ("チャット応答の名残「必要なら次に〜します」", r"^(必要なら|ご希望があれば|よろしければ)、?(次に|続けて|この後(?!の))[^。！？!?]*(?:ます|ましょう)(?:か|よ|ね|よね)?(?:（[^。！？!?（）]*）)?[。！？!?]?\z"),
]
SENTENCE_INFOS = [
    ("summary_restatement", r"^(まとめると|総じて)、"),
    ("meta_intro", r"^本記事では"),
    ("count_declaration", r"(ポイント|理由|観点|コツ|方法)は(3|三|３)つ(です|あります)|以下の(3|三|３)つの(観点|ポイント)"),
]
KATAKANA_TERMS = (
    "マイルストーン シナジー ソリューション エンゲージメント プラットフォーム コミットメント アライメント ナレッジ イニシアチブ バリュー スキーム インサイト エコシステム ケイパビリティ レバレッジ "
    "オポチュニティ ステークホルダー コンセンサス ロードマップ ベストプラクティス イノベーション トランスフォーメーション エクスペリエンス カスタマージャーニー タッチポイント モメンタム コアコンピタンス "
    "プレゼンス ウェルビーイング パーパス"
).split()
RENYO_NOUNS = (
    "確かめ 直し 比べ 測り 補い 決め 選び 集め 探し 捜し 整え 揃え そろえ 重ね 外し 戻し 削り 消し 残し 伏せ 伝え 預け 並べ 分け 混ぜ 減らし 増やし 広げ 縮め 伸ばし 延ばし 遅らせ 終え 続け 動かし 移し "
    "貼り 挙げ 数え 改め 入れ たしかめ くらべ おぎない ととのえ 育て 足し 試し"
).split()
RENYO_NOT_BEFORE = {"育て": "の親|の母|の父", "足し": "に", "試し": "に"}
THIN_NOUNS = [
    ("座り心地", "快適|よい|良い|いい|抜群"), ("使い心地", "よい|良い|いい|快適|抜群"), ("書き心地", "なめらか|滑らか|よい|良い|いい|抜群"), ("寝心地", "よい|良い|いい|快適|抜群"),
    ("履き心地", "よい|良い|いい|快適|抜群"), ("着心地", "よい|良い|いい|快適|抜群"), ("乗り心地", "快適|よい|良い|いい|抜群"), ("居心地", "よい|良い|いい|快適|抜群"),
    ("肌触り", "心地よい|心地良い|よい|良い|いい|なめらか|滑らか|抜群"), ("手触り", "心地よい|心地良い|よい|良い|いい|なめらか|滑らか|抜群"), ("質感", "上質|よい|良い|いい|高い|抜群"),
    ("使い勝手", "よい|良い|いい|抜群"), ("手軽さ", "抜群|魅力"), ("打鍵感", "心地よい|心地良い|よい|良い|いい|快適|抜群"), ("装着感", "快適|よい|良い|いい|抜群"),
    ("仕上がり", "美しい|きれい|綺麗|上質|抜群"), ("味わい", "深い|豊か|格別"), ("香り", "豊か|よい|良い|いい|格別"), ("操作性", "高い|優れてい(?:ます|る)|よい|良い|抜群"),
    ("視認性", "高い|優れてい(?:ます|る)|よい|良い|抜群"),
    *[(noun, "高い|優れてい(?:ます|る)|抜群") for noun in "利便性 快適性 安定性 耐久性 携帯性 静音性 保温性 信頼性 拡張性 保守性 可読性 機能性 デザイン性 品質 性能".split()],
]

# ---- fixed values: shapes --------------------------------------------------------------------------------------
EMOJI = "[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F700-\U0001F77F\U0001F780-\U0001F7FF\U0001F800-\U0001F8FF\U0001F900-\U0001F9FF\U0001FA00-\U0001FA6F\U0001FA70-\U0001FAFF☀-➿⌀-⏿⭐-⭕]"
DASHES = "—―─━"
DIAGRAM = r"[│┃├┣└┗┌┏┐┓┘┛┬┳┴┻┼╋╭╮╰╯]"
_ITEM = rf"[^、。！？!?\s{DASHES}]{{1,12}}"
CREDIT_LABEL = r"(?i)^(?:出典|引用元|著者|Source|Author)\s*[:：]"
CREDIT_BOOK = r"^[一-龥々ァ-ヴーA-Za-z .・'’-]+『[^』]+』(?:[ \t　]*(?:（[^）]*）|\([^)]*\)))*[。.]?\z"
CREDIT_ENGLISH = r"^[A-Z][A-Za-z.'’−-]*(?:[ \t]+[A-Z][A-Za-z.'’−-]*)+,[ \t]+\S"
LINK_CREDIT = rf"\][ \t]*[{DASHES}]+"
DASH_LIST_ENDING = rf"(?:^|(?<=[。！？!?]))\s*{_ITEM}(?:、[ \t　]*{_ITEM}){{2,}}[ \t　]*[{DASHES}]+(?:[。．.]|\z)"
DASH_INSERTION = rf"[{DASHES}]{{1,2}}[^{DASHES}。\n]{{1,40}}[{DASHES}]{{1,2}}"
NAKAGURO_SEGMENT = r"(?:[ァ-ヶー]+|[一-龯]+|[ぁ-ん]+|[0-9A-Za-z]+)"
NAKAGURO = rf"{NAKAGURO_SEGMENT}(?:[・･]{NAKAGURO_SEGMENT})+"
PROPER_SEGMENT = r"^(?:[ァ-ヶー]+|[A-Z])\z"
TWO_SENTENCES = r"[。！？](?![。！？」）』\s]*\z)"
SUMMARY_HEADING = r"^(?:#{1,6}\s*)?(まとめ|おわりに)(?:\s+#+)?\s*\z"
EMPTY_BRACKET = r"（(素の出力|いわゆる|概要|詳細|感謝と設計への反映)）"
BOLD_LABEL = r"^\s*(?:[-*+]|\d+[.)])\s+\*\*[^*]+?(?:\*\*\s*[:：]|[:：]\s*\*\*)"
NOT_BUT = r"[^。、]ではなく(?:[^。、]|、[^。、])"
NOT_BUT_ALSO = r"ではなく、?[^。]{1,40}?(?<!どこに)(?<!誰に)(?<!だれに)(?<!何)(?<!なん)(?<!いつ)でも(ある|あります|あった|ありました)"
NOT_THIS = r"^(?:(?:でも|しかし|つまり|ただ|ただし|けれども?|けど|だが|それでも|だから)、)?(?![い良]いじゃない、|すごいじゃない、|凄いじゃない、)[^。、]{1,15}じゃない、[^。]{1,30}(?:です|だ)(?:よ|ね|よね)?[。！!]?\z"
SHORT_OF_COURSE = r"^(もちろん|勿論)、[^。！？!?、「」『』]{1,10}[。！!]\z"
OF_COURSE_ANSWER = r"^(もちろん|勿論)、(大丈夫|構いません|かまいません|いいですよ|いいよ|できます|可能です|です|だ)"
QUESTION = r"([？?]|(ですか|ますか|ませんか|でしょうか|だろうか|のか|ないか|うか|くか|ぐか|すか|つか|ぬか|ぶか|むか|るか|たか|いいか|よいか)。?)[」』）)\"'*_\s]*\z"
WH_QUESTION = r"なぜ|どうして(?!も)|どのよう(?:に|な)|いつ(?!でも|も|か(?!ら))|どこ(?!でも|も|か(?!ら))|誰(?!でも|も|か(?!ら))|何(?!でも|も|か(?!ら))|どれ(?!でも|も|か(?!ら))|どの(?![^。！？!?、]{1,12}でも)"
FRAGMENTS = r"(?:^|(?<=[。！？]))(?:[^。！？、\s「」『』]{1,4}[。！]){3,}"
NOUN_CHAIN = r"[^\s、。！？「」（）：:<>はがをもと・]{1,15}の[^\s、。！？「」（）：:<>はがをもと・]{1,15}の[^\s、。！？「」（）：:<>はがをもと・]+"
ABSTRACT = r"(化|性|度|率|量|観|感|的|止|施|討|生|認|理|延|善|応|用|保|能|合|解|断|開|成|定|務|証|準|装|報)\z|[ァ-ヶー]{3,}"
CHAIN_MASK = r"一つの|ものの|ための|ので"
THIN_ADVERB = "(?:とても|非常に|大変|たいへん|すごく|かなり|十分に?|抜群に|格段に|より|さらに|一段と)?"
THIN_TAIL = "(?:です|でした|だ|だった|である|でございます|ですね|ですよ)?"
RENYO_BEFORE = r"(?<=[一-龥々〆ァ-ヴーぁ-んA-Za-z0-9０-９Ａ-Ｚａ-ｚ）」』\]) ])の"
RENYO_AFTER = r"(?=が(?!た[いかくけさそ])|を|は|に(?!く[いかくけさそ])|で|も(?!の)|と|や(?!す[いかくけさそ])|へ|の|だけ|まで|など|から|より|こそ|さえ|しか|ばかり|くらい|ぐらい|ほど|[、。，．）」』！？!?（(・／/:：|｜\s]|\z)"
SAY_HEDGE = r"(.{0,4})と(?:言|い)えるでしょう[。！!]?\z"
SAY_HEDGE_JUDGE = r"(?:(?:に|へ)(?:当た|あた)る|に該当する)と(?:言|い)えるでしょう"
SAY_HEDGE_NOUN = r"[一-龯々〆ヵヶァ-ヴーｦ-ﾟA-Za-z0-9０-９Ａ-Ｚａ-ｚ]\z"
SAY_HEDGE_ADJECTIVE = r"(?:的|重要|有効|必要|適切|十分|妥当|有用|大切|確実|可能|重大|有益|顕著|明確|不可欠|理想|最適|容易|困難|安全|安心)\z"
BARE_VERB = r"^[一-龯々ぁ-ゖァ-ヴー]*[うくぐすつぬぶむる]か?\z"
BARE_VERB_NOT = r"(?:ます|です|ません)か?\z|(?:^[一二三四五六七八九十百千0-9０-９いくひとふたみよ]+つ|しく)か?\z"
BARE_VERB_PARTICLE = r"を|[はがに](?![ぁ-ゖ])"
SENTENCE_ENDINGS = ["です", "ます", "でした", "ました", "である", "だ", "だろう"]
NUMBER = r"(?<![A-Za-z_0-9０-９.,．，])[0-9０-９]+(?:[.,．，][0-9０-９]+)*(?![_0-9０-９])"
FIRST_PERSON = r"(?<![公無])私(?![立鉄的物有服用語設費学道塾刑権財欲情事信案邸宅募企営益生淑書])|(?<![ぁ-ゖ手受引見])(?:わたくし|わたし(?!て|た(?!ち)|ます|まし|ませ)|ぼく(?![じしさめ])|おれ(?!い|る|た(?!ち)|て|ま|ば|ず|ろ|そ))|僕|俺|自分|筆者"
COPY_COMMA_NOUN = r"(?:^|、)([^、]+?[ないたの])、([一-龯々〆ヵヶぁ-ゖァ-ヴーA-Za-z0-9０-９Ａ-Ｚａ-ｚ]{1,7})。\z"
COPY_PARTICLE = r"を|[はがで](?![ぁ-ゖ])"
COPY_NOT_MODIFIER = "はい いいえ いい また まあ あの その この どの あのね ええ いや おい なお ただ しかし ちなみ つまり さて では".split()
COPY_I_NOUNS = "思い 想い 願い 違い 匂い 出会い 味わい 祝い 誓い 迷い 笑い 住まい 佇まい 問い 扱い 装い 幸い".split()
COPY_NOT_NOUN = r"(?:[るたすだてでねよわかぞぜさうくぐつぬぶむずじ]|ない|ません|しい|たい)\z|[はがにでの]"
QUOTES = {"「": "」", "『": "』"}
SPEAKER = r"^\s*(?:[-*+]\s+|\d+\.\s+)?([^\s：:「」『』（）()、。！？!?，,．.]{1,12})[ \t　]*[：:][ \t　]*(.+)\z"
NOT_SPEAKER = r"(?i)^(?:SE|ＳＥ|M|Ｍ|BGM|ＢＧＭ|[0-9０-９]+|(?:[0-9０-９]+)?(?:コマ|ページ|P|Ｐ)目?[0-9０-９]*|場所|時間|時|人物|登場人物|柱|ト書き?|注|メモ|備考)\z"
STAGE_NOTE = r"^[（(][^（）()]*[）)]\s*|\s*[（(][^（）()]*[）)]\z"
AI_PERSON = (
    r"(?:人|者|員|士|医|さん|様|さま|氏|先生|医師|専門家|アナリスト|エコノミスト|記者|筆者|編集部|当社|弊社|同社|会社|政府|当局|警察|検察|日銀|銀行|気象台|省|庁|局|都|府|県|市|区|町|村|国|自治体"
    r"|委員会|協会|機関|大学|研究所|チーム|部|課|業界|社長|会長|部長|課長|店長|院長|監督|代表|教授|首相|大臣|知事|市長|私|僕|わたし|ぼく|我々|われわれ|彼|彼女|あなた|皆さん"
)
AI_PLURAL = r"(?:たち|ら|ども|陣|側)?"
AI_JUDGE = rf"{AI_PERSON}){AI_PLURAL}(?:は|が|も|の|では|によると|によれば|としては)"
AI_INVITER = rf"{AI_PERSON}|上司|父|母|親|夫|妻|兄|姉|弟|妹|祖父|祖母|息子|娘|子ども|子供|家族|友人|知人|友達|先輩|後輩|同僚|店|当店|学校|団体|館|団|主催者|運営){AI_PLURAL}\z"
AI_HIDDEN = r"(?:リスク|問題|課題|罠|わな|落とし穴|危険性?|本質|闇|バグ)"
AI_HIDDEN_BEFORE = r"(?:各種の|様々な|さまざまな|多くの|数々の|大きな|思わぬ|見えない|本当の|深刻な|重大な|新たな)?"
AI_VIEW = r"(?:という|との|の)見立て(?:です|でした|だ|だった|である)[。．！!]*\z"
AI_INVITED = r"が招く(?=[一-龥々ァ-ヴー])"
AI_CUT = r"(?:[ぁ-ん]て|[んい]で|[一-龥々]て)[、，,][^。、，,]{1,20}?を[一-龥々]{2,}[。．]\z"
AI_FORMS = {
    "見立てです": AI_VIEW,
    "潜む": rf"{AI_HIDDEN}(?:が|も|は)[、，,]?潜(?:む|ん[でだ]|み|ま|め)|に潜(?:む|んでいる|んでいた|んだ){AI_HIDDEN_BEFORE}{AI_HIDDEN}(?!な)",
    "が招く": AI_INVITED,
    "欠かせない存在": r"今や[^。]*?欠かせない存在|欠かせない存在と(?:なって|なりつつ)",
    "という挙動を排除": r"という挙動を(?:排除|防止|阻止)",
    "なんよ": r"なんよね?[。．！!？?]*\z",
    "て形の体言止め": AI_CUT,
}
TE_NOT_VERB = [
    "について", "によって", "として", "に関して", "に対して", "を通して", "にとって", "につれて", "において",
    "にあたって", "に当たって", "に際して", "をめぐって", "を巡って", "に沿って", "にわたって", "に先立って",
    "そして", "さて", "すべて", "全て", "かつて", "やがて", "改めて", "あらためて", "初めて", "はじめて", "決して",
    "けっして", "大して", "たいして", "極めて", "きわめて", "あえて", "敢えて", "かえって", "却って", "至って",
    "総じて", "概して", "がいして", "おしなべて", "強いて", "果たして", "はたして", "従って", "したがって",
    "よって", "次いで", "ついで", "併せて", "あわせて", "合わせて", "続いて", "揃って", "そろって", "あて", "宛て",
    "めがけて", "目がけて", "を通じて", "に応じて", "に基づいて", "に基いて", "に加えて", "に向けて", "を受けて",
    "をもって", "に従って", "を含めて", "に限って", "にかけて", "に比べて", "に伴って", "を除いて", "を経て",
    "にて", "せいで", "くらいで", "ぐらいで",
]

# Sentences that announce how something will be written, and what excuses them.
WRITING_ACTION = (
    r"(?:書(?:きます|く|いてみます|いていきます)|(?:説明|紹介|解説)し(?:ます|ていきます)|まとめ(?:ます|る|ていきます)|お伝えし(?:ます|ていきます)|述べ(?:ます|る)"
    r"|振り返(?:ります|る|っていきます)|お話し?し(?:ます|ていきます)|お届けします|話していきます)[。！？!?]?\z"
)
RESIDUE_OPENER = r"^(?:この記事|本記事|本稿|このブログ|ここ|以下|今回)(?:では|は)"
WRITING_STYLE = (
    r"(?:トーン|文体|口調)で|(?:専門用語|箇条書き)を[\s　]*(?:できるだけ|なるべく)?(?:使わず|用いず|避け)|(?:AI|ＡＩ)(?:っぽさ|らしさ)(?:が出ないよう|を(?:抑え|なく|避け))"
    r"|飾らない言葉で|語り口で|トーンを意識|(?<![0-9０-９])[0-9０-９]+文?字(?:程度|以内|前後)?で"
)
WRITING_LIMIT = r"に(?:絞って|限定して|焦点を(?:当てて|絞って))|触れず|扱わず|立ち入らず|[はを]抜きにして"
SCOPE_EXCLUSION = rf"{RESIDUE_OPENER}[^。！？!?]*(?:扱いません|扱わない|触れません|触れない|省きます|省く|割愛します|省略します)[。！？!?]?\z"
READER_SCOPE = r"^(?:この|本)?(?:マニュアル|手順書|ガイド|論文|研究)(?:では|は)"
SCOPE_REFERENCE = r"参照|ご覧|別途|付録|後述|後ほど|別の?[^。！？!?]{0,8}(?:記事|ページ|章|節|報告書?|資料|文書|ガイド)|(?:後|次|前)の(?:章|節)|第[0-9０-９一二三四五六七八九十]+章"

# A list of nouns that ends a sentence after "what ... is,".
CLEFT_HEAD = r"^([^。！？!?]{0,60}?(?:[るたいうくすつぬむぶぐ]|な|[んい]だ))のは、"
CLEFT_NOUN_END = r"(?:[一-龥々〆ヵヶァ-ヴーｦ-ﾟA-Za-z0-9０-９Ａ-Ｚａ-ｚ%％さ]|(?<!の)み)"
CLEFT_COMMA_ITEM = rf"(?:(?!から|より)[^、，,・。！？!?「」『』（）()\[\]\s　をがはにでへ]){{0,14}}(?:{CLEFT_NOUN_END}|もの|こと|[しきれえげぎちせ]|(?<!ばか)り)"
CLEFT_MIXED_ITEM = rf"(?:(?!から|より|および)[^、，,・。！？!?「」『』（）()\[\]\s　をがはにでへとや]){{0,14}}(?:{CLEFT_NOUN_END}|もの)"
CLEFT_TAIL = r"(?:など|の[0-9０-９一二三四五六七八九十]+[つ点])?[。！!]?\z"
CLEFT_COMMAS = rf"{CLEFT_HEAD}{CLEFT_COMMA_ITEM}(?:[、，・]{CLEFT_COMMA_ITEM}){{2,}}{CLEFT_TAIL}"
CLEFT_MIXED = rf"{CLEFT_HEAD}({CLEFT_MIXED_ITEM}(?:(?:[、，・]|と|や|および){CLEFT_MIXED_ITEM})+){CLEFT_TAIL}"
CLEFT_JOINER = r"[とや]|および"
CLEFT_STEM = r"[一-龥々〆ヵヶ]+(?=[ぁ-ん]*\z)"

# Rules that the list of allowed words can take away, and those of them that lose single words.
ALLOW_RULES = "ai_phrase calque katakana_term metaphor_label metaphor_verb project_term renyo_noun slop_vocabulary translated_term".split()
ALLOW_PARTIAL = "ai_phrase calque katakana_term project_term renyo_noun".split()

# Two denials and then what holds.
NEGATION_NEGATIVE_END = (
    r"(?:[な無]い|[な無]かった|ません(?:でした)?)"
    r"(?:(?:の|ん)(?:だ|です|だった|でした|である|であった)|です|でした|でしょう|だろう|であろう)?(?:よね|よ|ね)?"
)
NEGATION_EXTRA = (
    r"(?:[^。、]{1,15}(?:では|じゃ)ない。[^。]{0,15}|[^。、]{1,15}(?<!それ)(?<!今)(?<!いつ)(?<!誰)(?<!何)でも、[^。、]{1,15})"
    r"(?<!何)(?<!なん)(?<!まんざら)(?<!とん)でもない。"
    rf"(?![^。！？!?]{{0,40}}{NEGATION_NEGATIVE_END}[。！!])"
    r"[^。！？!?]{1,40}(?:[うくぐすつぬぶむるいだた]|だけ)(?:よね|よ|ね)?[。！!]"
)
